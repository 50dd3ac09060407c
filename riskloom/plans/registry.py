"""Cases: a query of the library on the test tables, and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.plans.tables import Tables, duck_sql


@dataclass(frozen=True)
class Case:
    """`digits` are decimals per column for the comparison, on both sides alike."""

    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None = None
    digits: dict[str, int] = field(default_factory=dict)

    def query(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.run(Tables(spark, folder))
        return df.select(
            *[
                rounded(F.col(f"`{c}`"), self.digits[c]).alias(c) if c in self.digits else F.col(f"`{c}`")
                for c in df.columns
            ]
        )

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = duck_sql(self.sql)
        if not self.digits:
            return body
        parts = ", ".join(f'{rounded_sql(c, n)} as "{c}"' for c, n in self.digits.items())
        return f"select * replace ({parts}) from (\n{body}\n) checked"


def nudge(digits: int) -> float:
    """A step far below the rounding unit. Averages of cents often end in exactly half a
    unit, where the last bit of a sum would decide; the step moves them off that edge."""
    return 3.17 * 10.0 ** (-digits - 2)


HUGE = 1e9


def rounded(x: Column, digits: int) -> Column:
    """Decimals for ordinary values, five figures fewer than a double holds for huge ones."""
    near = F.round(x + F.lit(nudge(digits)), digits) + F.lit(0.0)  # no negative zero
    return F.when(F.abs(x) < HUGE, near).when(F.abs(x) < float("inf"), F.round(x + F.lit(317.0), -4)).otherwise(x)


def rounded_sql(c: str, digits: int) -> str:
    x = f'"{c}"'
    return (
        f"case when abs({x}) < {HUGE:e} then round({x} + {nudge(digits):e}, {digits}) + 0e0 "
        f"when abs({x}) < cast('inf' as double) then round({x} + 317e0, -4) else {x} end"
    )


CASES: dict[str, Case] = {}


def case(name: str, sql: str | None = None, r6: str = "", r4: str = "", r2: str = ""):
    """Register the decorated function as a case; r6/r4/r2 list columns by decimals."""
    digits = {c: n for cols, n in ((r6, 6), (r4, 4), (r2, 2)) for c in cols.split()}

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in CASES:
            raise ValueError(f"case {name} is registered twice")
        CASES[name] = Case(name, fn, sql, digits)
        return fn

    return add


def money(expr: str, digits: int = 2) -> str:
    """SQL that rounds a double by its shortest decimal form, as Spark's `round` does."""
    return f"cast(round(cast(cast({expr} as varchar) as decimal(38, 15)), {digits}) as double)"
