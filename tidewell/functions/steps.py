"""Named intermediate columns, so that an expression used often is computed once.

Catalyst keeps a projection whose columns are used more than once, and each
projection stays inside whole-stage code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Steps:
    def __init__(self, df: DataFrame):
        self.df, self.columns, self.count = df, df.columns, 0

    def keep(self, *values: Column) -> list[Column]:
        """Adds the values as columns and returns references to them."""
        names = [f"__step{self.count + k}" for k in range(len(values))]
        self.count += len(values)
        self.df = self.df.select("*", *[v.alias(n) for v, n in zip(values, names)])
        return [F.col(n) for n in names]

    def done(self, **values: Column) -> DataFrame:
        """The first columns with the results (which may replace some)."""
        rest = [F.col(c) for c in self.columns if c not in values]
        return self.df.select(*rest, *[v.alias(n) for n, v in values.items()])
