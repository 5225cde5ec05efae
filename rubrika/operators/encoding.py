"""Corpus vocabulary and fixed-length token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubrika.functions.text import clean_text, tokens
from rubrika.operators.selection import largest
from rubrika.schemas import MAX_LENGTH, VOCABULARY_SIZE

# Ids below the first learned token.
PAD, UNK, CLS, SEP = 0, 1, 2, 3
SPECIAL_TOKENS = 4

# A vocabulary up to this many rows (some 100 bytes each) may be broadcast; beyond it the join
# shuffles on the token and this many salts, so a frequent token is spread over as many tasks.
BROADCAST_ROWS = 500_000
TOKEN_SALTS = 32


def with_tokens(df: DataFrame, text: str = "text", clean: bool = True) -> DataFrame:
    """Adds the array column ``tokens``."""
    source = clean_text(F.col(text)) if clean else F.col(text)
    named = df.withColumn("_source", source)
    return named.withColumn("tokens", tokens(F.col("_source"))).drop("_source")


def each_token(df: DataFrame, *keep: str) -> DataFrame:
    """One row per token, beside the columns to keep.

    The outer form is on purpose: for the inner one the optimizer adds a filter on the array's
    size below, which would split every text twice.
    """
    rows = df.select(*keep, F.explode_outer("tokens").alias("token"))
    return rows.where(F.col("token").isNotNull())


def token_counts(df: DataFrame) -> DataFrame:
    """Occurrences per token. Counts combine before the shuffle, so a token that makes up a
    third of the corpus costs one row per task."""
    return each_token(df).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def build_vocabulary(counts: DataFrame, size: int = VOCABULARY_SIZE) -> DataFrame:
    """The most frequent tokens with ids after the special ones; ties go by token.

    ``counts`` should be a stored table, as the choice reads it a few times. The window has no
    partition key, but sees no row that is not chosen.
    """
    best = largest(counts, size - SPECIAL_TOKENS)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    return best.select("token", (rank + (SPECIAL_TOKENS - 1)).alias("token_id"), "n")


def _join_ids(pieces: DataFrame, vocabulary: DataFrame, key: str, broadcast_rows: int) -> DataFrame:
    lookup = vocabulary.select("token", "token_id")
    if lookup.count() <= broadcast_rows:
        return pieces.join(F.broadcast(lookup), "token", "left")
    salts = F.explode(F.sequence(F.lit(0), F.lit(TOKEN_SALTS - 1))).alias("salt")
    salt = F.pmod(F.xxhash64(key, "pos"), F.lit(TOKEN_SALTS)).cast("int")
    # Told to shuffle: its files are small beside its rows times the salts.
    return pieces.withColumn("salt", salt).join(
        lookup.select("token", "token_id", salts).hint("merge"), ["token", "salt"], "left"
    )


def encode(
    df: DataFrame,
    vocabulary: DataFrame,
    key: str = "doc_id",
    max_length: int = MAX_LENGTH,
    pad: bool = True,
    broadcast_rows: int = BROADCAST_ROWS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``input_ids`` and ``attention_mask`` per document: start, tokens, end, padding.

    Tokens past ``max_length`` are cut, as in the model's input. ``key`` must be unique and not
    null; else the query fails, whatever the lengths. Columns named in ``carry``, such as the label,
    are passed on. ``vocabulary`` should be a stored
    table: its rows are counted to choose the join. Only the key and ids travel: ids of one
    document meet in the task that split it, so the shuffle carries one array per document and
    no text.
    """
    room = max_length - 2
    pieces = df.select(
        key, *carry, F.posexplode_outer(F.slice("tokens", 1, room)).alias("pos", "token")
    )
    found = F.when(F.col("token").isNotNull(), F.coalesce("token_id", F.lit(UNK)))
    placed = F.when(found.isNotNull(), F.struct("pos", found.alias("id")))
    ordered = F.array_sort(F.collect_list(placed))
    # Each document has one first token, or one row without a token.
    first = F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0)
    repeated = F.raise_error(F.concat(F.lit(f"{key} is not unique: "), F.col(key).cast("string")))
    ordered = (
        F.when(F.col(key).isNull(), F.raise_error(F.lit(f"{key} is null")))
        .when(first > 1, repeated)
        .otherwise(ordered)
    )
    ids = F.concat(
        F.array(F.lit(CLS)), F.transform(ordered, lambda s: s["id"]), F.array(F.lit(SEP))
    )
    encoded = (
        _join_ids(pieces, vocabulary, key, broadcast_rows)
        .groupBy(key)
        .agg(ids.alias("ids"), *[F.first(c).alias(c) for c in carry])
        .withColumn("mask", F.transform("ids", lambda _: F.lit(1)))
    )
    if pad:
        missing = F.array_repeat(F.lit(PAD), max_length - F.size("ids"))
        encoded = encoded.withColumns(
            {"ids": F.concat("ids", missing), "mask": F.concat("mask", missing)}
        )
    return encoded.select(
        key, F.col("ids").alias("input_ids"), F.col("mask").alias("attention_mask"), *carry
    )
