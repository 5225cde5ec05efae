"""The exact largest rows of a counted table, without sorting it and without gathering more than asked.

The lowest count among the largest is found from a histogram: counts below ``EXACT`` have a bucket each,
larger ones a bucket per leading ``EXACT`` // 2 steps of their power of two. Where the bucket that
holds the border is wider than one count, it gets a histogram of its own. Rows at the border itself are
cut by token: numbers of tokens by first letters, a letter further each time, until few enough
are left to order. Then a comparison with border and cut picks the rows where they lie.

The driver sees a row per bucket or per next letter; no task sees more than its share of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = 4096
BITS = 12
# So many tokens with the same first letters may be put in order by one task.
ORDERED = 100_000


def _bucket() -> Column:
    """The lowest number of the bucket of ``_n``."""
    shift = f"greatest(length(bin(_n)) - {BITS}, 0)"
    return F.expr(f"shiftleft(shiftright(_n, {shift}), {shift})")


def border(counts: DataFrame, size: int) -> tuple[int, int] | None:
    """The lowest count among the ``size`` largest, and how many rows have more; none if there are no
    more than ``size`` rows."""
    low, width, above = 0, None, 0
    while True:
        inside = counts.where(F.col("n") >= low)
        if width:
            inside = inside.where(F.col("n") < low + width)
        shifted = inside.select((F.col("n") - low).cast("long").alias("_n"))
        rows = shifted.groupBy(_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("rows")).collect()
        for bucket, found in sorted(map(tuple, rows), reverse=True):
            if above + found >= size:
                break
            above += found
        else:
            return None
        low, width = low + bucket, 1 << max(bucket.bit_length() - BITS, 0)
        if width == 1:
            return low, above


def smallest_token(tied: DataFrame, place: int, ordered: int = ORDERED) -> str:
    """The token at ``place``, from 1, of distinct tokens in order."""
    first = ""
    while True:
        here = tied.where(F.col("token").startswith(first))
        start = F.left("token", F.lit(len(first) + 1)).alias("start")
        for start, found in sorted(map(tuple, here.groupBy(start).agg(F.count(F.lit(1))).collect())):
            if found >= place:
                break
            place -= found
        if start == first:
            return first
        if found <= ordered:
            group = tied.where(F.col("token").startswith(start))
            return group.select("token").orderBy("token").limit(place).agg(F.max("token")).first()[0]
        first = start


def largest(counts: DataFrame, size: int) -> DataFrame:
    """The ``size`` rows of the largest ``n``, equal ones by token; all rows if there are no more.

    ``counts`` has one row per token and is read a few times, so it should be a stored table.
    """
    found = border(counts, size)
    if found is None:
        return counts
    lowest, above = found
    cut = smallest_token(counts.where(F.col("n") == lowest), size - above)
    return counts.where((F.col("n") > lowest) | ((F.col("n") == lowest) & (F.col("token") <= cut)))
