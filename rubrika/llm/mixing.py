"""Mixing sources to target weights by weighted sampling without replacement.

Each source gets a share of all words by its weight, at most ``MAX_EPOCHS`` times its own size; what
is cut off goes to the others by weight. A source's target then is so many complete epochs and a
rest. For the rest, every document gets a key -ln(u) / quality (Efraimidis and Spirakis: the smallest
keys are a sample weighted by quality), documents are sorted by key within the source, and sizes are
summed up to the rest. The document at that border gives its first words only, so that the words
taken come to the target.

The running sums need no source in one task: keys fall into ``BINS`` bins by their rank transform
1 - exp(-key), bins into groups, and only the one bin that holds the border is sorted.

Cases: null or empty text has size 0 and is never cut; null source is a source of its own, last in
order; a null id counts as id 0 for its random number; rows that repeat an id are separate documents,
ordered by size; an empty table gives no rows; other columns are not read, except by
``take_documents``, whose own columns replace columns of the same name.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rubrika.llm.common import one_of_equal, slices, stored, utf8
from rubrika.llm.words import find

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
FINE = 1 << 10  # bins of a group, and groups
CHUNK_BYTES = 2 << 20
LEAST_QUALITY = 0.25
_MEASURED = "doc_id long, source string, row long, size long, quality double"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _measure(batches):
    """Words of each text, and the share of A-Z, a-z and of bytes beyond ASCII in it."""
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        sizes, quality = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
        for i, j in slices(offsets, CHUNK_BYTES):
            part = data[offsets[i] : offsets[j]]
            cut = offsets[i : j + 1] - offsets[i]
            sizes[i:j] = find(part, cut)[2]
            letters = np.concatenate(([0], np.cumsum(_LETTER[part] | (part > 127))))
            quality[i:j] = np.diff(letters[cut]) / np.maximum(np.diff(cut), 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), pa.array(sizes), pa.array(quality)],
            names=["doc_id", "source", "row", "size", "quality"],
        )


def measure(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """Size and quality weight (``LEAST_QUALITY`` to 1) of each document; ``row`` is passed on."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        "text",
        (F.lit(0) if row is None else row).cast("long").alias("row"),
    ).mapInArrow(_measure, _MEASURED)
    return rows.withColumn("quality", F.greatest(F.col("quality"), F.lit(LEAST_QUALITY)))


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, source_size``.

    Resharing the excess by weight until none is above ends where every source below its limit has
    weight * level words, with one level for all. That level follows from running sums over the
    sources in order of limit / weight. These windows see a row per source, in one task.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    everything = W.partitionBy(F.lit(0))
    array = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("rank", F.row_number().over(order) - 1)
    rows = rows.select(
        "source",
        "source_size",
        F.element_at(array, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * float(max_epochs)).alias("limit"),
        F.sum("source_size").over(everything).cast("double").alias("total"),
        F.sum(F.element_at(array, (F.col("rank") % len(weights) + 1).cast("int"))).over(everything).alias("all"),
    )
    filled = W.orderBy(F.col("limit") / F.col("weight"), "limit", F.col("source").isNull(), "source")
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("cut"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("gone"),
    ).withColumn("level", (F.col("total") - F.col("cut")) / (F.col("all") - F.col("gone")))
    # The level is that of the first source whose limit is not reached; limits before it are full.
    open_level = F.min_by(
        F.col("level"),
        F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.col("limit") / F.col("weight")),
    ).over(everything)
    level = F.coalesce(open_level, F.lit(float("inf")))
    return rows.select(
        "source",
        "source_size",
        F.least(F.col("limit"), F.col("weight") * level).alias("target"),
    )


# Up to this many sources their plan may be broadcast; beyond it rows of a source meet it under salts.
BROADCAST_SOURCES = 100_000
SALTS = 32
KEY_SEEDS = 4


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from id and seed: 52 bits of an MD5."""
    text = F.concat(F.coalesce(doc_id, F.lit(0)).cast("string"), F.lit(":" + seed))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def mix(
    docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, row: Column | None = None
) -> DataFrame:
    """``doc_id, row, source, size, quality, source_size, target, epochs, extra, taken``: a document is
    taken ``epochs`` times whole and ``extra`` more words of it. ``row`` tells apart documents with one id."""
    rows = stored(
        measure(docs, row)
        .withColumn("key", -F.log(uniform(F.col("doc_id"), seed)) / F.col("quality"))
        .withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("key"))) * FINE * FINE), F.lit(FINE * FINE - 1)))
        .withColumn("grp", F.floor(F.col("bin") / FINE))
        .withColumn("source", F.struct("source")),  # a struct joins null with null
        "mixing",
    )
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(per_source.select("source.source", "source_size"), weights, max_epochs)
    goals = goals.select(F.struct("source").alias("source"), "source_size", "target").withColumn(
        "epochs",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0),
    ).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    goals = stored(goals, "mixing-goals")

    # Which group of bins, then which bin holds the border.
    by_bin = rows.groupBy("source", "grp", "bin").agg(F.sum("size").alias("n"))
    by_bin = stored(by_bin, "mixing-bins")
    by_group = by_bin.groupBy("source", "grp").agg(F.sum("n").alias("n"))

    def starts(frame: DataFrame, over: list[str], key: str) -> Column:
        window = W.partitionBy(*over).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(window), F.lit(0))

    group_start = by_group.select("source", "grp", starts(by_group, ["source"], "grp").alias("before"))
    bin_start = (
        by_bin.join(group_start, ["source", "grp"])
        .select("source", "bin", "n", (F.col("before") + starts(by_bin, ["source", "grp"], "bin")).alias("before"))
        .join(goals.select("source", "rest"), "source")
    )
    border = bin_start.where("before < rest AND before + n > rest").select(
        "source", F.col("bin").alias("border"), F.col("before").alias("border_before")
    )
    # With no border inside a bin, whole bins make up the rest.
    last = bin_start.where("before + n <= rest").groupBy("source").agg(F.max("bin").alias("last"))
    plan = goals.join(border, "source", "left").join(last, "source", "left")
    if goals.count() <= BROADCAST_SOURCES:
        placed = rows.join(F.broadcast(plan), "source")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("key", "row"), F.lit(SALTS)).cast("int"))
        placed = salted.join(plan.select("*", salts), ["source", "salt"]).drop("salt")
    sums = W.partitionBy("source", "bin").orderBy("key", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    at_border = (
        placed.where("bin = border")
        .withColumn("seen", F.col("border_before") + F.coalesce(F.sum("size").over(sums), F.lit(0)))
        .withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("seen"))))
        .drop("seen")
    )
    others = placed.where("border IS NULL OR bin <> border").withColumn(
        "extra", F.when(F.col("bin") <= F.col("last"), F.col("size")).otherwise(0)
    )
    return at_border.unionByName(others).select(
        "doc_id",
        "row",
        "source.source",
        "size",
        "quality",
        "source_size",
        "target",
        F.col("epochs").cast("long").alias("epochs"),
        F.col("extra").cast("long").alias("extra"),
        (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
    )


def _first_words(text: pd.Series, words: pd.Series) -> pd.Series:
    """The text up to the end of its ``words``-th word."""

    def head(t: str, n: int) -> str:
        found = next(itertools.islice(_WORD.finditer(t), n - 1, None), None)
        return t if found is None else t[: found.end()]

    return pd.Series([head(t, int(n)) for t, n in zip(text, words)], dtype=object)


def take_documents(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` as the mix takes them: a document as often as it has epochs, then once more
    if it is in the sample; the one at the border of each source ends after its last word that
    counts. Rows equal in id and text count once."""
    columns = docs.columns
    first_words = F.pandas_udf(_first_words, "string")
    for seed in range(KEY_SEEDS):
        first = docs.withColumn("_key", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")))
        counted = first.groupBy("_key").agg(
            F.count(F.lit(1)).alias("n"), *[f(F.xxhash64(F.lit("other"), "doc_id", "text")).alias(f.__name__) for f in (F.min, F.max)]
        )
        repeated = stored(counted.where("n > 1"), "repeated-keys")
        if repeated.where("min <> max").isEmpty():
            break
    else:
        raise ValueError("different rows have the same 64-bit key")
    first = one_of_equal(first, ("_key",), repeated.select("_key"))
    plan = mix(first, row=F.col("_key"), **options)
    once = F.array_repeat(F.col("size"), F.col("epochs").cast("int"))
    extra = F.when(F.col("extra") > 0, F.array("extra")).otherwise(F.array().cast("array<bigint>"))
    times = plan.select(
        F.col("row").alias("_key"), F.col("size").alias("_size"), F.explode(F.concat(once, extra)).alias("_words")
    )
    taken = first.join(times, "_key")
    whole = taken.where("_words >= _size")
    cut = taken.where("_words < _size").withColumn("text", first_words("text", "_words"))
    return whole.unionByName(cut).select(*columns)
