"""Checks on what callers pass, made on the driver before any job starts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


class InvalidInput(ValueError):
    """Values outside their domain, or a frame without the columns an operator needs."""


def check_values(values: Iterable | None, domain: Iterable, what: str = "value") -> None:
    """Every value lies in the domain; None stands for all of it. NaN equals null."""
    same = lambda v: None if v is None or v != v else v
    known = {same(v) for v in domain}
    strange = [v for v in values or () if same(v) not in known]
    if strange:
        raise InvalidInput(f"{what}: {strange} not in {sorted(known, key=str)}")


def check_edges(df: DataFrame, frame: list[str], weighted: bool = False) -> DataFrame:
    """An edge list has its frame, both ends and, if weighted, a numeric weight."""
    kinds = dict(df.dtypes)
    missing = [c for c in [*frame, "src", "dst", *(["weight"] if weighted else [])] if c not in kinds]
    if missing:
        raise InvalidInput(f"no column {', '.join(missing)} in {df.columns}")
    if weighted and kinds["weight"].split("(")[0] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
        raise InvalidInput(f"weight is {kinds['weight']}")
    return df


def unique_columns(df: DataFrame) -> DataFrame:
    """The first of every group of columns that share a name."""
    first = [i for i, c in enumerate(df.columns) if c not in df.columns[:i]]
    names = [df.columns[i] for i in first]
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*[f"_{i}" for i in first]).toDF(*names)
