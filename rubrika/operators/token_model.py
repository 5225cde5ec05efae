"""Naive Bayes over every token of the corpus, as a stored table."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrika.functions.scores import softmax
from rubrika.operators.selection import largest
from rubrika.operators.training import NUM_LABELS, class_sizes, class_token_counts

ROW_KEY = ("_row", "_again")
# So many tokens with their weights (some 100 bytes each) may be broadcast, the most frequent ones of
# those that take at most so many bytes themselves.
FREQUENT_TOKENS = 50_000
FREQUENT_BYTES = 128


@dataclass(frozen=True)
class TokenModel:
    """Token counts per class, log shares of the classes, and smoothed totals per class.

    ``counts`` is a stored table with one row per token, of any number of rows.
    """

    counts: DataFrame
    log_priors: list[float]
    totals: list[float]

    def transform(self, df: DataFrame, broadcast_rows: int = FREQUENT_TOKENS) -> DataFrame:
        """Adds ``probabilities`` to a frame with ``tokens``; tokens never seen have no part.

        The ``broadcast_rows`` most frequent tokens of at most ``FREQUENT_BYTES`` bytes meet their
        counts by broadcast and are added up per row in the tasks, whatever the size of the model.
        The others travel once per row and join by token: each is rare, so no task gets much of one,
        or long; one that is long and frequent is split by adaptive execution. The salt is the token's
        hash, and for the sums without such a token the row's, which spreads them. The sums per row of ``df``
        are numbers; text is not among them. Rows are told apart by two hashes over all columns;
        rows equal in every column share one sum and each gets it.
        """
        columns = [c for c in df.columns if c != "tokens"]
        keyed = df.withColumns(
            {"_row": F.xxhash64(*columns), "_again": F.xxhash64(F.lit(1), *columns)}
        )
        classes = range(len(self.totals))
        logs = [F.log((F.col(f"n_{c}") + 1) / F.lit(self.totals[c])).alias(f"w_{c}") for c in classes]
        pieces = keyed.select(*ROW_KEY, F.posexplode_outer("tokens").alias("pos", "token"))
        rows = F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("rows")
        adds = [F.sum(f"w_{c}").alias(f"w_{c}") for c in classes]
        short = self.counts.where(F.octet_length("token") <= FREQUENT_BYTES)
        size = self.counts.count()
        if size <= broadcast_rows and short.count() == size:
            weights = self.counts.select("token", *logs)
            sums = pieces.join(F.broadcast(weights), "token", "left").groupBy(*ROW_KEY).agg(rows, *adds)
        else:
            frequent = largest(short, broadcast_rows) if broadcast_rows else self.counts.limit(0)
            found = pieces.join(F.broadcast(frequent.select("token", *logs)), "token", "left")
            rare = F.when(F.col("w_0").isNull(), F.col("token")).alias("token")
            added = found.groupBy(*ROW_KEY, rare).agg(rows, F.count(F.lit(1)).alias("times"), *adds)
            hashed = F.xxhash64("token").alias("salt")
            salt = F.when(F.col("token").isNull(), F.col("_row")).otherwise(hashed)
            # A frequent token is null here, so the whole model may stand on the other side.
            weights = self.counts.select("token", hashed, *logs)
            both = added.withColumn("salt", salt).alias("l").join(
                weights.hint("merge").alias("r"), ["token", "salt"], "left"
            )
            given = [
                F.sum(F.coalesce(f"l.w_{c}", F.col(f"r.w_{c}") * F.col("times"))).alias(f"w_{c}")
                for c in classes
            ]
            sums = both.groupBy(*ROW_KEY).agg(F.sum("rows").alias("rows"), *given)
        logits = F.array(
            *[
                F.coalesce(F.col(f"w_{c}") / F.col("rows"), F.lit(0.0)) + F.lit(self.log_priors[c])
                for c in classes
            ]
        )
        shares = sums.select(*ROW_KEY, softmax(logits).alias("probabilities"))
        return keyed.join(shares, list(ROW_KEY), "left").drop(*ROW_KEY)

    def save(self, path: str) -> None:
        """Writes the model as two tables, replacing one at the same place."""
        spark = self.counts.sparkSession
        rows = [(c, p, t) for c, (p, t) in enumerate(zip(self.log_priors, self.totals))]
        self.counts.write.mode("overwrite").parquet(f"{path}/counts")
        classes = spark.createDataFrame(rows, "label int, log_prior double, total double")
        classes.coalesce(1).write.mode("overwrite").parquet(f"{path}/classes")


def fit_token_model(train: DataFrame, path: str, num_labels: int = NUM_LABELS) -> TokenModel:
    """Fits multinomial naive Bayes with add-one smoothing and stores it under ``path``.

    ``train`` has ``tokens`` and ``label``. Every token stays, however many there are: counts come
    from one aggregation that combines in the tasks, and the driver sees a row per class.
    """
    sizes = class_sizes(train, num_labels)
    class_token_counts(train, num_labels).write.mode("overwrite").parquet(f"{path}/counts")
    counts = train.sparkSession.read.parquet(f"{path}/counts")
    sums = counts.agg(
        F.count(F.lit(1)).alias("v"), *[F.sum(f"n_{c}").alias(f"t_{c}") for c in range(num_labels)]
    ).first()
    totals = [float((sums[f"t_{c}"] or 0) + max(sums["v"], 1)) for c in range(num_labels)]
    rows = [
        (c, log((d + 1) / (sum(sizes) + num_labels)), totals[c]) for c, d in enumerate(sizes)
    ]
    classes = train.sparkSession.createDataFrame(rows, "label int, log_prior double, total double")
    classes.coalesce(1).write.mode("overwrite").parquet(f"{path}/classes")
    return load_token_model(train.sparkSession, path)


def load_token_model(spark: SparkSession, path: str) -> TokenModel:
    """Reads a stored model; fails where there is none."""
    classes = spark.read.parquet(f"{path}/classes").orderBy("label").collect()
    return TokenModel(
        spark.read.parquet(f"{path}/counts"),
        [row["log_prior"] for row in classes],
        [row["total"] for row in classes],
    )
