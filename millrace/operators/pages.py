"""Pages of a large result: sorted once into a directory of ranges, then read range by range."""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordering import ranges
from millrace.operators.profile import as_text
from millrace.util import require, scratch


class PageDirectory:
    """All rows of a frame in a given order, as one file set per range, with their numbers of rows.

    Building it is one range shuffle; after that a page of any depth reads the one or two ranges it
    lies in, and of these only the row groups with its positions. The driver holds one number per
    range, of which there are as many as shuffle partitions.
    """

    def __init__(self, df: DataFrame, order_by):
        self.schema = df.schema
        path = scratch(df.sparkSession, "pages")
        placed = ranges(df, order_by)
        placed.write.partitionBy("_part").parquet(path)
        self.rows = df.sparkSession.read.schema(placed.schema).parquet(path)
        counted = self.rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()
        self.parts, sizes = zip(*sorted(map(tuple, counted))) if counted else ((), ())
        self.ends = list(accumulate(sizes))

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def page(self, number: int, rows: int, within: int | None = None) -> DataFrame:
        """Page ``number`` (from 1) of all rows, or of the first ``within``, every cell as text."""
        require(number >= 1 and rows >= 1, "pages and rows are counted from 1")
        first = (number - 1) * rows
        last = min(first + rows, len(self), len(self) if within is None else within)
        wanted = F.lit(False)
        if first < last:
            for i in range(bisect_right(self.ends, first), bisect_right(self.ends, last - 1) + 1):
                before = self.ends[i - 1] if i else 0
                low, high = max(first - before, 0), min(last, self.ends[i]) - before
                wanted = wanted | ((F.col("_part") == self.parts[i]) & (F.col("_pos") >= low)
                                   & (F.col("_pos") < high))
        # A page is small, so that one task may sort it.
        found = self.rows.where(wanted).orderBy("_part", "_pos")
        return found.select([as_text(f) for f in self.schema])

    def page_count(self, rows: int, within: int | None = None) -> int:
        require(rows >= 1, "a page has at least one row")
        return math.ceil((len(self) if within is None else min(within, len(self))) / rows)
