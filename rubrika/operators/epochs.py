"""Training by epochs: a multinomial logistic model, gradient steps over all rows, evaluation and stored
state after each epoch.

Features are the shares of vocabulary tokens among a document's tokens. They are made once, without a
shuffle, and stored; each step reads its rows, every task adds up one dense gradient, and
gradients meet in a tree of ``FAN`` at a time, in the order of their tasks, so the same rows give the same
sums. An epoch is ``steps`` steps, each over the rows that a hash gives it. After an epoch weights and
metrics are written; a run that finds epochs under its path goes on after the last whole one, and
ends as if it had never stopped. The model is that of the epoch with the best accuracy on
held-out rows, the first of equals.

The driver holds the vocabulary and a number per token and class; ``MAX_WEIGHTS`` bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrika.operators.encoding import each_token, token_counts
from rubrika.operators.selection import largest
from rubrika.operators.training import NUM_LABELS, class_sizes
from rubrika.schemas import VOCABULARY_SIZE
from rubrika.sources import files

FAN = 16
MAX_WEIGHTS = 8_000_000  # 64 MB
FEATURES = "label int, step int, ids array<int>, shares array<double>"
PARTIAL = "part int, gradient binary, loss double, hits long, n long"
PARTIAL_TYPES = pa.schema(
    [("part", pa.int32()), ("gradient", pa.binary()), ("loss", pa.float64()), ("hits", pa.int64()), ("n", pa.int64())]
)
STATE = "epoch int, weights binary, velocity binary, train_loss double, loss double, accuracy double, n_train long, n_test long"


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Values of a list column, the row of each, and the number in each row."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), np.repeat(np.arange(len(lists)), sizes), sizes


def _shares(tokens: pa.ListArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, token id and share of each distinct known token of each row."""
    flat, row, sizes = _flat(tokens)
    ids = pc.index_in(flat, value_set=vocabulary)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    pair = row[known] * len(vocabulary) + ids.drop_null().to_numpy().astype(np.int64)
    pair, count = np.unique(pair, return_counts=True)
    row = pair // max(len(vocabulary), 1)
    return row, pair - row * len(vocabulary), count / sizes[row]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _logits(rows: int, row: np.ndarray, ids: np.ndarray, shares: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.empty((rows, weights.shape[1]))
    for c in range(weights.shape[1]):
        out[:, c] = np.bincount(row, weights[ids, c] * shares, rows)
    return out


def features(df: DataFrame, vocabulary: list[str], steps: int) -> DataFrame:
    """Rows with a label as token ids and shares; ``step`` says which step of an epoch has the row."""
    known = pa.array(vocabulary, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ids, shares = _shares(batch.column(2), known)
            edges = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [
                pa.ListArray.from_arrays(edges, pa.array(ids, pa.int32())),
                pa.ListArray.from_arrays(edges, pa.array(shares, pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["label", "step", "ids", "shares"])

    step = F.pmod(F.xxhash64("tokens"), F.lit(steps)).cast("int")
    rows = df.where(F.col("label").isNotNull())
    return rows.select(F.col("label").cast("int"), step.alias("step"), "tokens").mapInArrow(run, FEATURES)


def _sums(rows: DataFrame, weights: np.ndarray, gradient: bool) -> dict:
    """Loss, hits and number of rows, and on request the gradient, over all rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, hits, n = np.zeros_like(weights), 0.0, 0, 0
        for batch in batches:
            truth = batch.column(0).to_numpy()
            flat, row, _ = _flat(batch.column(1))
            ids, shares = flat.to_numpy(), batch.column(2).flatten().to_numpy()
            p = softmax(_logits(len(truth), row, ids, shares, weights))
            loss -= float(np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-15)).sum())
            hits += int((p.argmax(axis=1) == truth).sum())
            n += len(truth)
            if gradient:
                p[np.arange(len(truth)), truth] -= 1
                for c in range(weights.shape[1]):
                    total[:, c] += np.bincount(ids, p[row, c] * shares, len(weights))
        if n:
            raw = total.tobytes() if gradient else b""
            found = {"part": [TaskContext.get().partitionId()], "gradient": [raw], "loss": [loss], "hits": [hits], "n": [n]}
            yield pa.RecordBatch.from_pydict(found, PARTIAL_TYPES)

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        total = sum((np.frombuffer(r["gradient"]) for r in rows), np.zeros(len(rows[0]["gradient"]) // 8))
        values = {name: [sum(r[name] for r in rows)] for name in ("loss", "hits", "n")}
        return pa.Table.from_pydict({"part": [rows[0]["part"]], "gradient": [total.tobytes()], **values}, PARTIAL_TYPES)

    found = rows.select("label", "ids", "shares").mapInArrow(partial, PARTIAL)
    span, parts = FAN, rows.rdd.getNumPartitions()
    while span < parts:
        found = found.groupBy(F.floor(F.col("part") / span)).applyInArrow(add, PARTIAL)
        span *= FAN
    got = found.toArrow()
    if not got.num_rows:
        return {"gradient": np.zeros_like(weights), "loss": 0.0, "hits": 0, "n": 0}
    row = add(got).to_pylist()[0]
    summed = np.frombuffer(row["gradient"])
    return {**row, "gradient": summed.reshape(weights.shape) if gradient else None}


@dataclass(frozen=True)
class EpochModel:
    """Weights by token id and class; ``vocabulary`` holds the tokens in the order of their ids."""

    vocabulary: list[str]
    weights: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probabilities`` to a frame with ``tokens``; tokens never seen have no part."""
        known, weights = pa.array(self.vocabulary, pa.string()), self.weights

        @F.arrow_udf("array<double>")
        def run(tokens: pa.Array) -> pa.Array:
            p = softmax(_logits(len(tokens), *_shares(tokens, known), weights))
            edges = pa.array(np.arange(len(tokens) + 1) * weights.shape[1], pa.int32())
            return pa.ListArray.from_arrays(edges, pa.array(p.ravel()))

        return df.withColumn("probabilities", run("tokens"))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        rows = [(k, t, [float(w) for w in self.weights[k]]) for k, t in enumerate(self.vocabulary)]
        table = spark.createDataFrame(rows, "token_id int, token string, weights array<double>")
        table.write.mode("overwrite").parquet(f"{path}/epoch-weights")


def load_epoch_model(spark: SparkSession, path: str) -> EpochModel:
    rows = spark.read.parquet(f"{path}/epoch-weights").orderBy("token_id").collect()
    return EpochModel([r["token"] for r in rows], np.array([r["weights"] for r in rows]))


def _once(df_of, path: str, spark: SparkSession) -> DataFrame:
    """A table written unless it is there whole."""
    if not files.exists(spark, f"{path}/_SUCCESS"):
        df_of().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def train_epochs(
    train: DataFrame,
    held_out: DataFrame,
    path: str,
    epochs: int = 2,
    steps: int = 1,
    rate: float = 100.0,
    momentum: float = 0.0,
    vocabulary_size: int = VOCABULARY_SIZE,
    num_labels: int = NUM_LABELS,
) -> tuple[EpochModel, list[dict]]:
    """Trains from zero weights, or from what is stored under ``path``, and returns the best model and
    the metrics of each epoch; epoch 0 is the start. ``train`` and ``held_out`` have ``tokens`` and
    ``label`` (class ids from 0); rows without a label are left out of the held-out ones. A path
    belongs to one corpus and one choice of options."""
    if vocabulary_size * num_labels > MAX_WEIGHTS:
        raise ValueError(f"vocabulary_size times classes may be at most {MAX_WEIGHTS}")
    spark = train.sparkSession
    class_sizes(train, num_labels)
    counts = _once(lambda: token_counts(train), f"{path}/token-counts", spark)
    chosen = largest(counts, vocabulary_size).select("token", "n").collect()  # at most vocabulary_size rows
    vocabulary = [r["token"] for r in sorted(chosen, key=lambda r: (-r["n"], r["token"]))]
    rows = _once(lambda: features(train, vocabulary, steps), f"{path}/train", spark)
    check = _once(lambda: features(held_out, vocabulary, 1), f"{path}/held-out", spark)

    shape = (len(vocabulary), num_labels)
    weights, velocity, state = np.zeros(shape), np.zeros(shape), []
    for epoch in range(epochs + 1):
        folder = f"{path}/state/epoch={epoch}"
        if not files.exists(spark, f"{folder}/_SUCCESS"):
            losses = []
            for step in range(steps if epoch else 0):
                mine = rows.where(F.col("step") == step) if steps > 1 else rows
                sums = _sums(mine, weights, True)
                velocity = momentum * velocity - rate * sums["gradient"] / max(sums["n"], 1)
                weights = weights + velocity
                losses.append((sums["loss"], sums["n"]))
            test = _sums(check, weights, False)
            seen = sum(n for _, n in losses)
            row = (
                epoch,
                weights.tobytes(),
                velocity.tobytes(),
                sum(loss for loss, _ in losses) / seen if seen else None,
                test["loss"] / test["n"] if test["n"] else None,
                test["hits"] / test["n"] if test["n"] else None,
                rows.count(),
                test["n"],
            )
            spark.createDataFrame([row], STATE).coalesce(1).write.mode("overwrite").parquet(folder)
        row = spark.read.schema(STATE).parquet(folder).first().asDict() | {"epoch": epoch}
        weights = np.frombuffer(row.pop("weights")).reshape(shape)
        velocity = np.frombuffer(row.pop("velocity")).reshape(shape)
        state.append(row)
    best = max(range(epochs + 1), key=lambda k: (state[k]["accuracy"] or 0.0, -k))
    for k, row in enumerate(state):
        row["is_best"] = k == best
    stored = spark.read.schema(STATE).parquet(f"{path}/state/epoch={best}").first()["weights"]
    return EpochModel(vocabulary, np.frombuffer(stored).reshape(shape)), state
