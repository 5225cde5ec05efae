"""Fitting classifiers on tokenised, labelled documents.

Every fit takes a frame with ``tokens`` (array of strings) and ``label`` (class ids from 0) and
returns a ``PipelineModel`` that scores in the JVM without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from math import log

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrika.operators.encoding import BROADCAST_ROWS, each_token
from rubrika.operators.selection import largest
from rubrika.schemas import LABELS, VOCABULARY_SIZE

NUM_LABELS = len(LABELS)
HASH_FEATURES = 1 << 16
# Every task sends a dense gradient per iteration; two rounds of partial sums meet them first.
AGGREGATION_DEPTH = 3


def class_token_counts(train: DataFrame, num_labels: int = NUM_LABELS) -> DataFrame:
    """One row per token: ``n`` in all and ``n_<class>`` per class.

    One shuffle on the token after partial counts; the classes are columns, not keys.
    """
    per_class = [
        F.count_if(F.col("label") == c).alias(f"n_{c}") for c in range(num_labels)
    ]
    return (
        each_token(train, "label")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"), *per_class)
    )


def top_tokens(counts: DataFrame, vocabulary_size: int = VOCABULARY_SIZE) -> DataFrame:
    """The model's vocabulary: the most frequent tokens, ties by token. ``counts`` should be stored."""
    return largest(counts, vocabulary_size)


def log_likelihoods(vocabulary: DataFrame, num_labels: int = NUM_LABELS) -> DataFrame:
    """Smoothed log probability of each vocabulary token in each class, long form."""
    totals = vocabulary.agg(
        F.count(F.lit(1)).alias("v"),
        *[F.sum(f"n_{c}").alias(f"t_{c}") for c in range(num_labels)],
    ).first()
    size = totals["v"]
    columns = [
        F.struct(
            F.lit(c).alias("label"),
            F.col(f"n_{c}").alias("n"),
            F.log((F.col(f"n_{c}") + 1) / F.lit(float((totals[f"t_{c}"] or 0) + size))).alias(
                "log_prob"
            ),
        )
        for c in range(num_labels)
    ]
    return vocabulary.select("token", F.inline(F.array(*columns)))


def class_log_priors(train: DataFrame, num_labels: int = NUM_LABELS) -> list[float]:
    """Smoothed log share of each class."""
    sizes = class_sizes(train, num_labels)
    return [log((d + 1) / (sum(sizes) + num_labels)) for d in sizes]


def id_weights(
    vocabulary: DataFrame, likelihoods: DataFrame, num_labels: int = NUM_LABELS
) -> np.ndarray:
    """Log likelihoods as a matrix by token id and class, zero for the special tokens.

    The driver gets one row per vocabulary token and class.
    """
    rows = vocabulary.join(likelihoods, "token").select("token_id", "label", "log_prob").toArrow()
    ids, labels, values = (rows[name].to_numpy() for name in rows.column_names)
    weights = np.zeros((int(ids.max()) + 1, num_labels))
    weights[ids, labels] = values
    return weights


def class_sizes(train: DataFrame, num_labels: int) -> list[int]:
    """Documents per class, by a scan of the label column alone."""
    inside = F.col("label").isNotNull() & F.col("label").between(0, num_labels - 1)
    row = train.agg(
        F.count_if(~F.coalesce(inside, F.lit(False))).alias("outside"),
        *[F.count_if(F.col("label") == c).alias(f"d_{c}") for c in range(num_labels)],
    ).first()
    sizes = [row[f"d_{c}"] for c in range(num_labels)]
    if row["outside"]:
        raise ValueError(f"{row['outside']} training rows have no class in 0..{num_labels - 1}")
    if not all(sizes):
        raise ValueError(f"every class needs training rows, found {sizes}")
    return sizes


def fit_naive_bayes(
    train: DataFrame,
    vocabulary_size: int | None = None,
    num_labels: int = NUM_LABELS,
    smoothing: float = 1.0,
    max_tokens: int = BROADCAST_ROWS,
) -> PipelineModel:
    """Multinomial naive Bayes with add-one smoothing.

    The fit depends on the corpus only through token counts per class. Those come from one
    distributed aggregation; the estimator then sees one weighted row per class, whose features
    are mean counts. The driver holds every token with its counts, which is for corpora of at most
    ``max_tokens`` distinct tokens: with more the fit fails, as it never drops one unasked
    (``token_model.fit_token_model`` takes any number). ``vocabulary_size`` asks for the most
    frequent tokens alone.
    """
    if vocabulary_size and vocabulary_size > max_tokens:
        raise ValueError(f"vocabulary_size may be at most {max_tokens}")
    sizes = class_sizes(train, num_labels)
    counts = class_token_counts(train, num_labels)
    if vocabulary_size:
        with _kept(counts) as kept:
            counts = top_tokens(kept, vocabulary_size).toArrow()
    else:
        counts = counts.limit(max_tokens + 1).toArrow()
        if len(counts) > max_tokens:
            raise ValueError(f"more than {max_tokens} distinct tokens, use fit_token_model")
    spark = train.sparkSession
    tokens = spark.createDataFrame(counts.select(["token"]))
    vectorizer = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=max(len(counts), 1))
    vectorizer = vectorizer.fit(tokens.select(F.array("token").alias("tokens")))
    counts = counts.to_pandas().set_index("token").loc[vectorizer.vocabulary]
    rows = []
    for c, documents in enumerate(sizes):
        n = counts[f"n_{c}"].to_numpy()
        seen = n.nonzero()[0]
        features = Vectors.sparse(len(n), seen.tolist(), (n[seen] / documents).tolist())
        rows.append((float(c), float(documents), features))
    classes = spark.createDataFrame(rows, ["label", "weight", "features"])
    bayes = NaiveBayes(modelType="multinomial", smoothing=smoothing, weightCol="weight").fit(classes)
    return PipelineModel([vectorizer, bayes])


@contextmanager
def _kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` kept on memory and disk for several passes; lost parts are rebuilt from source."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def _logistic(max_iter: int, reg_param: float) -> LogisticRegression:
    return LogisticRegression(
        family="multinomial",
        maxIter=max_iter,
        regParam=reg_param,
        aggregationDepth=AGGREGATION_DEPTH,
    )


def fit_logistic(
    train: DataFrame,
    num_features: int = HASH_FEATURES,
    max_iter: int = 10,
    reg_param: float = 0.01,
) -> PipelineModel:
    """Multinomial logistic regression on hashed TF-IDF; gradients are tree-aggregated."""
    grid = [(max_iter, reg_param)]
    return _fit_grid(train, grid, num_features, lambda _: {})[0]


def select_logistic(
    train: DataFrame,
    held_out: DataFrame,
    grid: Iterable[tuple[int, float]],
    num_features: int = HASH_FEATURES,
) -> tuple[PipelineModel, list[dict]]:
    """The candidate with the best held-out accuracy, the first one on ties, and all metrics.

    ``grid`` holds pairs of iteration count and regularisation.
    """
    with _kept(held_out.select("label", "tokens")) as check:

        def measure(model: PipelineModel) -> dict:
            scored = model.transform(check)
            return {
                name: MulticlassClassificationEvaluator(metricName=metric).evaluate(scored)
                for name, metric in (("accuracy", "accuracy"), ("log_loss", "logLoss"))
            }

        return _fit_grid(train, grid, num_features, measure)


def _fit_grid(
    train: DataFrame,
    grid: Iterable[tuple[int, float]],
    num_features: int,
    measure: Callable[[PipelineModel], dict],
) -> tuple[PipelineModel, list[dict]]:
    """Fits every candidate on term counts that are hashed once and kept for all passes."""
    hashing = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features)
    metrics, models = [], []
    with _kept(hashing.transform(train).select("label", "tf")) as counts:
        idf = IDF(inputCol="tf", outputCol="features").fit(counts)
        ready = idf.transform(counts).select("label", "features")
        for max_iter, reg_param in grid:
            fitted = _logistic(max_iter, reg_param).fit(ready)
            models.append(PipelineModel([hashing, idf, fitted]))
            metrics.append({"max_iter": max_iter, "reg_param": reg_param, **measure(models[-1])})
    best = max(range(len(models)), key=lambda i: metrics[i].get("accuracy", 0.0))
    for i, result in enumerate(metrics):
        result["is_best"] = i == best
    return models[best], metrics
