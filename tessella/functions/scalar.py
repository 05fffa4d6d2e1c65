"""String, number, date, binary and conditional helpers; all are built-in expressions, none runs Python on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What trim() strips.
BLANKS = " \t\n\r"

#: Steps of format_bytes().
UNITS = ("B", "KB", "MB", "GB", "TB")


def trim(s: Column) -> Column:
    return F.btrim(s, F.lit(BLANKS))


def split_nonempty(s: Column, delimiter: str) -> Column:
    """Tokens between single-character delimiters, empty ones dropped."""
    return F.filter(F.split(s, f"\\Q{delimiter}\\E", -1), lambda x: x != "")


def join_strings(parts: Column, delimiter: str) -> Column:
    return F.array_join(parts, delimiter)


def replace_all(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss.SSS")


def time_text(ts: Column) -> Column:
    """There is no TIME type: times are text."""
    return F.date_format(ts, "HH:mm:ss")


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def next_power_of_two(n: Column) -> Column:
    """The least power of two that is n or more; n itself up to 1. Shifts, so that no rounding enters."""
    bits = F.length(F.bin(n.cast("long") - 1))
    return F.when(n <= 1, n.cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bits))


def round_to(x: Column, digits: int) -> Column:
    """Half away from zero."""
    return F.round(x, digits)


def percentage(x: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(x, total) * 100)


def align_down(x: Column, step: int) -> Column:
    """step: a power of two."""
    return x.cast("long").bitwiseAND(F.lit(-step).cast("long"))


def align_up(x: Column, step: int) -> Column:
    return align_down(x.cast("long") + (step - 1), step)


def is_aligned(x: Column, step: int) -> Column:
    return x.cast("long").bitwiseAND(F.lit(step - 1).cast("long")) == 0


def format_bytes(n: Column, units: tuple[str, ...] = UNITS) -> Column:
    """Two digits and a unit, in steps of 1024, the last unit for all that is larger; halves go to the even digit, null stays null."""

    def shown(k: int) -> Column:
        return F.format_string(f"%.2f {units[k]}", F.bround(n.cast("double") / float(1024**k), 2))

    out = shown(len(units) - 1)
    for k in range(len(units) - 2, -1, -1):
        out = F.when(n < 1024 ** (k + 1), shown(k)).otherwise(out)
    return F.when(n.isNotNull(), out)


def is_uuid(s: Column) -> Column:
    return F.coalesce(s.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lit(False))


def int_div(x: Column, y: Column) -> Column:
    """Whole numbers: truncated quotient, null for a divisor of zero, whatever the session's ANSI setting."""
    return F.when(y != 0, F.call_function("div", x, F.nullif(y, F.lit(0).cast("int"))))


def to_text(x: Column) -> Column:
    return x.cast("string")


def random_int(low: int, high: int, seed: int | None = None) -> Column:
    """Whole numbers from low to high, both included."""
    return F.floor(F.rand(seed) * (high - low + 1)).cast("long") + low


def random_double(low: float, high: float, seed: int | None = None) -> Column:
    return F.rand(seed) * (high - low) + low


def random_bool(share: float = 0.5, seed: int | None = None) -> Column:
    return F.rand(seed) < share
