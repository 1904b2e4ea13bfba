"""Columns that an operator hands on unread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Carried:
    """The ``keep`` columns of ``docs`` under names that clash with nothing,
    beside the text, and their way back to their own names.

    A kept column whose name is also that of a result (``results``, whatever
    the case) comes back with ``_in`` behind its name.
    """

    def __init__(self, docs: DataFrame, keep: list[str], text_col: str, results: list[str]):
        self.keep = [f"_k{i}" for i in range(len(keep))]
        self.text = self.keep[keep.index(text_col)] if text_col in keep else "_text"
        kept = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, self.keep, strict=True)])
        self.schema = ", ".join(f"{k} {t}" for k, t in kept.dtypes)
        extra = [] if text_col in keep else [F.col(f"`{text_col}`").alias("_text")]
        self.columns = [*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, self.keep, strict=True)], *extra]
        self.rows = docs.select(*self.columns)
        taken = {r.lower() for r in results}
        self.names = []
        for c in keep:
            while c.lower() in taken:
                c += "_in"
            taken.add(c.lower())
            self.names.append(c)

    def back(self, df: DataFrame) -> list:
        """Select list that gives the kept columns their names."""
        return [df[k].alias(n) for k, n in zip(self.keep, self.names, strict=True)]


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of the keys, with the ``text`` of the smallest hash."""
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    return rows.groupBy(*keys).agg(least.alias("_least")).select(*keys, F.col("_least.text").alias("text"))
