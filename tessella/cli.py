"""The command line: python -m tessella.cli [-c SQL | -f FILE]; without either, a prompt."""

from __future__ import annotations

import argparse
import cmd
import pydoc
import shutil
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame

from . import __doc__ as about
from .engine import Engine
from .plans.dialect import DialectError, tokens
from .session import make_session

try:
    import readline
except ImportError:  # without it there is neither completion nor a saved history
    readline = None

VERSION = "0.1.0"

#: Rows shown, and lines of history kept.
SHOWN, HISTORY = 1000, 1000

HISTORY_FILE = Path.home() / ".tessella_history"


#: Words that are highlighted and completed.
KEYWORDS = frozenset(
    "SELECT FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET JOIN LEFT RIGHT FULL INNER CROSS ON USING AS AND OR NOT IN EXISTS BETWEEN LIKE IS NULL CASE WHEN THEN ELSE END DISTINCT UNION ALL INTERSECT EXCEPT "
    "INSERT INTO VALUES UPDATE SET DELETE CREATE TABLE VIEW INDEX UNIQUE SEQUENCE DROP ALTER RENAME TO ADD COLUMN PRIMARY KEY FOREIGN REFERENCES CHECK DEFAULT BEGIN COMMIT ROLLBACK SAVEPOINT EXPLAIN ANALYZE".split()
)

META = ("clear", "describe", "echo", "exit", "help", "highlight", "history", "list", "pager", "quit", "sleep", "stats", "timing", "verbose")

_COLOURS = {"keyword": "34", "string": "32", "number": "36", "comment": "90"}


def highlight(sql: str) -> str:
    """sql with terminal colours for keywords, strings and numbers; as it is where a string isn't closed."""
    try:
        some = tokens(sql)
    except DialectError:
        return sql
    kinds = ["keyword" if t.kind == "word" and t.key in KEYWORDS else t.kind for t in some]
    return "".join(f"\033[{_COLOURS[k]}m{t.text}\033[0m" if k in _COLOURS else t.text for t, k in zip(some, kinds, strict=True))


def cell(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x)


def grid(df: DataFrame, most: int = SHOWN) -> tuple[str, int]:
    """An ASCII table of the first rows, and their number."""
    rows = [[cell(x) for x in r] for r in df.limit(most).collect()]
    widths = [max(map(len, column)) for column in zip(df.columns, *rows, strict=True)]
    rule = "+".join(["", *("-" * (w + 2) for w in widths), ""])

    def line(cells: list[str]) -> str:
        return "|".join(["", *(f" {c:<{w}} " for c, w in zip(cells, widths, strict=True)), ""])

    return "\n".join([rule, line(df.columns), rule, *map(line, rows), rule]), len(rows)


class Shell(cmd.Cmd):
    """Statements end with a semicolon; lines that start with a backslash are the shell's own."""

    intro = "Statements end with ; and \\help lists commands."
    prompt, more = "sql> ", "...> "

    def __init__(self, engine: Engine, timing: bool = True, verbose: bool = False, out=None):
        super().__init__(stdout=out or sys.stdout)
        self.engine, self.timing, self.verbose, self.pager, self.highlight = engine, timing, verbose, True, False
        self.pending = ""
        self.past: list[str] = []
        self.stats = {"queries": 0, "errors": 0, "rows": 0, "seconds": 0.0}

    def say(self, text: object) -> None:
        print(text, file=self.stdout)

    def show(self, text: str) -> None:
        """Text that may be longer than the screen: a page at a time, if the pager is on and someone sits there."""
        if self.pager and self.stdout is sys.stdout and sys.stdout.isatty() and text.count("\n") >= shutil.get_terminal_size().lines:
            pydoc.pager(text)
        else:
            self.say(text)

    def candidates(self, text: str) -> list[str]:
        """Keywords, tables, views and columns, or the shell's own commands, that start like text."""
        if text.startswith("\\"):
            return [f"\\{m}" for m in META if f"\\{m}".startswith(text)]
        names = {*self.engine.tables(), *self.engine.views(), *(c for t in self.engine.tables() for c in self.engine.schema(t).names)}
        words = {k if text.isupper() else k.lower() for k in KEYWORDS}
        return sorted(x for x in names | words if text and x.startswith(text))

    def complete(self, text: str, state: int) -> str | None:
        found = self.candidates(text)
        return found[state] if state < len(found) else None

    def preloop(self) -> None:
        if readline:
            readline.set_completer_delims(" \t\n,;()=<>+-*/")
            if HISTORY_FILE.exists():
                readline.read_history_file(HISTORY_FILE)
            readline.set_history_length(HISTORY)

    def postloop(self) -> None:
        if readline:
            readline.write_history_file(HISTORY_FILE)

    def onecmd(self, line: str) -> bool:
        if line == "EOF":
            return True
        if not self.pending and line.lstrip().startswith("\\"):
            return self.meta(line.strip())
        self.pending = f"{self.pending}\n{line}" if self.pending else line
        if self.pending.rstrip().endswith(";"):
            text, self.pending = self.pending, ""
            self.run(text)
        self.prompt = Shell.more if self.pending.strip() else Shell.prompt
        return False

    def emptyline(self) -> bool:
        return False

    def run(self, text: str) -> bool:
        self.past = [*self.past, text.strip()][-HISTORY:]
        start = time.perf_counter()
        try:
            df = self.engine.sql(text)
            if df.columns == ["affected"]:
                self.say(f"{df.first()[0]} rows affected")
            else:
                shown, n = self.engine.timed(lambda: grid(df))
                self.show(shown)
                self.say(f"{n} rows")
                self.stats["rows"] += n
        except Exception as e:
            self.stats["errors"] += 1
            self.say(f"Error: {e if self.verbose else str(e).splitlines()[0]}")
            return False
        finally:
            seconds = time.perf_counter() - start
            self.stats["queries"] += 1
            self.stats["seconds"] += seconds
        if self.timing:
            self.say(f"Time: {seconds:.3f} s")
        return True

    def meta(self, line: str) -> bool:
        name, _, rest = line[1:].partition(" ")
        rest = rest.strip()
        if name in ("quit", "exit", "q"):
            return True
        if name == "help":
            self.say("\\help \\quit \\exit \\clear \\list [tables|views|indexes] \\describe TABLE \\timing \\verbose \\pager \\highlight \\history \\stats \\echo TEXT \\sleep SECONDS")
        elif name == "clear":
            self.say("\033[2J\033[H")
        elif name == "list":
            self.say("\n".join(getattr(self.engine, rest if rest in ("views", "indexes") else "tables")()))
        elif name == "describe":
            self._guard(lambda: self.say(grid(self.engine.describe(rest))[0]))
        elif name in ("timing", "verbose", "pager", "highlight"):
            setattr(self, name, not getattr(self, name))
            self.say(f"{name} is {'on' if getattr(self, name) else 'off'}")
        elif name == "history":
            self.show("\n".join(f"{k}  {highlight(s) if self.highlight else s}" for k, s in enumerate(self.past, 1)))
        elif name == "stats":
            self.say("\n".join(f"{k}: {v:.3f}" if isinstance(v, float) else f"{k}: {v}" for k, v in self.stats.items()))
        elif name == "echo":
            self.say(rest)
        elif name == "sleep":
            self._guard(lambda: time.sleep(float(rest or 0)))
        else:
            self.say(f"No command \\{name}; \\help lists them.")
        return False

    def _guard(self, run) -> None:
        try:
            run()
        except Exception as e:
            self.say(f"Error: {e}")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessella", description=about)
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-V", "--version", action="version", version=VERSION)
    p.add_argument("--no-pager", action="store_true")
    p.add_argument("--no-timing", action="store_true")
    p.add_argument("-c", metavar="SQL", help="run these statements and end")
    p.add_argument("-f", metavar="FILE", help="run a file's statements and end")
    p.add_argument("--root", default="tessella-data", help="where tables are kept")
    a = p.parse_args(argv)
    shell = Shell(Engine(make_session(), a.root), timing=not a.no_timing, verbose=a.verbose)
    shell.pager = not a.no_pager
    if a.c or a.f:
        return 0 if shell.run(a.c or Path(a.f).read_text(encoding="utf-8")) else 1
    shell.cmdloop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
