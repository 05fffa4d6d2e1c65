"""Queries that find rows against a table's constraints."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConstraintViolation(ValueError):
    """Rows break a constraint; nothing was changed."""


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def check_rows(df: DataFrame, schema: T.StructType, constraints: list[dict[str, Any]], table: str) -> None:
    """What each row must keep by itself: NOT NULL, lengths, CHECK (null passes). One pass finds all of them."""
    tests = []
    for f in schema:
        if not f.nullable:
            tests.append((f"NOT NULL on {f.name}", F.col(f.name).isNull()))
        if isinstance(f.dataType, (T.VarcharType, T.CharType)):
            tests.append((f"length {f.dataType.length} of {f.name}", F.char_length(f.name) > f.dataType.length))
    for c in constraints:
        if c["kind"] == "CHECK":
            tests.append((f"CHECK ({c['expression']})", ~F.coalesce(F.expr(c["expression"]), F.lit(True))))
    if not tests:
        return
    broken = reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for _, t in tests))
    row = df.where(broken).select(*(F.coalesce(t, F.lit(False)).alias(str(k)) for k, (_, t) in enumerate(tests))).limit(1).collect()
    if row:
        raise ConstraintViolation(f"{table}: {next(name for k, (name, _) in enumerate(tests) if row[0][k])} is broken")


def check_unique(new: DataFrame, old: DataFrame | None, columns: list[str], table: str) -> None:
    """New keys differ from one another and from the old ones, of which only those that meet a new key are looked at.

    Keys with a null are exempt; counts are partial before the shuffle.
    """
    keys = new.dropna(subset=columns).select(*columns)
    broken = _any(keys.groupBy(*columns).count().where("count > 1"))
    if not broken and old is not None:
        theirs = old.select(*(F.col(c).alias(f"_o{k}") for k, c in enumerate(columns)))
        broken = _any(theirs.join(keys, reduce(lambda a, b: a & b, (F.col(f"_o{k}") == F.col(c) for k, c in enumerate(columns))), "left_semi"))
    if broken:
        raise ConstraintViolation(f"{table}: UNIQUE ({', '.join(columns)}) is broken")


def check_orphans(child: DataFrame, columns: list[str], before: DataFrame, after: DataFrame, keys: list[str], table: str) -> None:
    """No child's key is among the parent's keys that are gone; other children are not looked at."""
    gone = before.select(*keys).distinct().join(after.select(*keys).distinct(), keys, "left_anti").toDF(*(f"_g{k}" for k in range(len(keys))))
    if _any(child.join(gone, reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_g{k}") for k, c in enumerate(columns))), "left_semi")):
        raise ConstraintViolation(f"{table}: FOREIGN KEY ({', '.join(columns)}) is broken")


def check_foreign(child: DataFrame, columns: list[str], parent: DataFrame, keys: list[str], table: str) -> None:
    """Every key of the child without a null is in the parent."""
    mine = child.dropna(subset=columns).select(*(F.col(c).alias(f"_c{k}") for k, c in enumerate(columns)))
    theirs = parent.select(*(F.col(c).alias(f"_p{k}") for k, c in enumerate(keys)))
    on = reduce(lambda a, b: a & b, (F.col(f"_c{k}") == F.col(f"_p{k}") for k in range(len(columns))))
    if _any(mine.join(theirs, on, "left_anti")):
        raise ConstraintViolation(f"{table}: FOREIGN KEY ({', '.join(columns)}) is broken")
