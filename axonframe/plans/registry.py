"""Registration of queries: a Spark plan, its output columns, and its SQL counterpart.

Columns are declared once ("node:long mean:double"); both forms are projected on them,
cast, and doubles rounded to six places, so that results compare by value.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lifts import SQL, Tables

DIGITS = 6
#: Added before rounding, so that exact ties at the last place do not hang on the order of sums.
NUDGE = 1.7e-8
_SQL_TYPE = {"long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    columns: tuple[tuple[str, str], ...]
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.plan(Tables(spark, sf_dir))
        out = []
        for name, kind in self.columns:
            c = F.col(name).cast(kind)
            out.append((F.round(c + NUDGE, DIGITS) + F.lit(0.0) if kind == "double" else c).alias(name))
        return df.select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        parts = []
        for name, kind in self.columns:
            c = f'CAST("{name}" AS {_SQL_TYPE[kind]})'
            parts.append(f'round({c} + {NUDGE}, {DIGITS}) + 0.0 AS "{name}"' if kind == "double" else f'{c} AS "{name}"')
        own, needed = [], set()

        def need(text: str) -> None:
            for k in SQL:
                if k not in needed and re.search(rf"\b{k}\b", text):
                    needed.add(k)
                    need(SQL[k])
                    own.append(k)

        need(self.sql)
        head = ", ".join(f"{k} AS ({SQL[k]})" for k in own)
        body = self.sql.strip()
        recursive = "RECURSIVE " if "RECURSIVE" in body else ""
        if m := re.match(r"WITH (RECURSIVE )?", body):  # its own tables follow the lifts
            head = f"{head}, " if head else ""
            tables, final = split_with(body[m.end() :])
            return f"WITH {recursive}{head}{tables}, result AS ({final}) SELECT {', '.join(parts)} FROM result"
        return f"WITH {head + ', ' if head else ''}result AS ({body}) SELECT {', '.join(parts)} FROM result"


def split_with(text: str) -> tuple[str, str]:
    """The table definitions of a WITH clause, and the final query after them."""
    depth = at = 0
    while True:
        c = text[at]
        depth += (c == "(") - (c == ")")
        at += 1
        if c == ")" and depth == 0:
            rest = text[at:].lstrip()
            if rest[:1] != "," and not re.match(r"AS\b", rest, re.I):
                return text[:at], rest


REGISTRY: dict[str, Query] = {}


def query(name: str, operators: str, columns: str, sql: str | None = None):
    def register(plan: Callable[[Tables], DataFrame]):
        kinds = tuple((c.split(":")[0], c.split(":")[1]) for c in columns.split())
        REGISTRY[name] = Query(name, operators, kinds, plan, sql)
        return plan

    return register
