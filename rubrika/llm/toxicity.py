"""Toxic texts: a convolutional classifier over hashed words, trained in numpy.

Words, from first to last letter and A-Z as a-z, are hashed to embeddings. Filters of one to three
words slide over the whole text, each keeps its largest response, and a linear layer gives a logit.
The first embedding dimension starts as the log-odds of the word among toxic texts; all others at
random. Training uses Adam on minibatches; only the windows that won the pooling have gradients.

Thresholds are set on all labelled rows, for each language apart, by the largest F1. Rows fall into
``PARTS`` parts by a hash of their id, a first model is fitted without each part, and Spark scores the
part's whole texts with it and counts logits in bins of 1 / ``GRID``. The final model is fitted with
all parts and takes these thresholds over. The language is told from the text by its function words, so no other column is an input. The
threshold of the language is taken off the logit, and the score is the logistic function of the rest:
0.5 is the threshold everywhere.

The fit uses at most ``PER_CLASS`` rows of each label, the first by a hash of their id, as long as
their texts make up to ``CLASS_CHARS`` characters in all. Texts count whole, as what makes one toxic
may be anywhere; only of one longer than ``TEXT_CHARS`` a window is read, at a place that a hash of
the id chooses.

Cases: null and empty texts are scored as texts without words; without labelled rows of both kinds
every score is the share of toxic rows (0 without any); a part without which the
sample lacks a label sets no threshold; a language with fewer than ten rows of a label takes the
threshold of all languages together; null labels and rows without an id are not learned; rows pass one by
one, repeated or not, with their other columns; ``score`` and ``predicted`` replace columns of these
names; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubrika.llm.common import slices, utf8
from rubrika.llm.words import cores, find, span_hashes

BITS = 16
DIM = 8
FILTERS = 12
WIDTHS = (1, 2, 3)
PER_CLASS = 3000
PARTS = 5
CLASS_CHARS = 36_000_000
TEXT_CHARS = 1_000_000
GRID = 1000  # bins per unit of the logit
EPOCHS = 6
BATCH = 64
RATE = 0.01
CHUNK_BYTES = 1 << 20

# Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in that was for with his this from which",
    "de": "der die und das von ist den mit sich des auf nicht ein eine",
    "fr": "le les et des du une dans qui pour est sur pas par",
    "es": "el los las del que y por con una para su al",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


@dataclass
class Cnn:
    embedding: np.ndarray  # words by dimensions
    kernels: list[np.ndarray]  # per width: places by dimensions by filters
    bias: np.ndarray  # of all filters
    out: np.ndarray
    base: float
    thresholds: np.ndarray  # logits, per language

    def tables(self) -> list[np.ndarray]:
        """Responses of each place of each filter to each word."""
        return [np.stack([self.embedding @ k for k in kernel]).astype(np.float32) for kernel in self.kernels]


def _hash_words(words: str) -> np.ndarray:
    data, offsets = utf8(pa.array([words], pa.large_string()))
    starts, ends, _ = find(data, offsets)
    return span_hashes(data, starts, ends)


_KNOWN = np.concatenate([_hash_words(w) for w in FUNCTION_WORDS.values()])
_KNOWN_LANGUAGE = np.repeat(np.arange(len(FUNCTION_WORDS)), [len(w.split()) for w in FUNCTION_WORDS.values()])
_order = np.argsort(_KNOWN)
_KNOWN, _KNOWN_LANGUAGE = _KNOWN[_order], _KNOWN_LANGUAGE[_order]


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers with two pads (0) after each document, where documents start, and languages."""
    starts, ends, counts = find(data, offsets)
    begin, end = cores(data, starts, ends)
    h = span_hashes(data, begin, end)
    doc = np.repeat(np.arange(len(counts)), counts)
    pad = max(WIDTHS) - 1
    words = np.zeros(len(h) + pad * len(counts), np.int64)
    words[np.arange(len(h)) + pad * doc] = (h % np.uint64((1 << BITS) - 1)).astype(np.int64) + 1
    at = np.minimum(np.searchsorted(_KNOWN, h), len(_KNOWN) - 1)
    hit = _KNOWN[at] == h
    votes = np.zeros((len(counts), len(LANGUAGES)), np.int64)
    np.add.at(votes, (doc[hit], _KNOWN_LANGUAGE[at[hit]]), 1)
    votes[:, -1] = 1
    return words, np.cumsum(counts + pad) - counts - pad, votes.argmax(1)


def _encode_all(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words and starts of many texts, a few at a time."""
    words, starts, at = [], [], 0
    for k in range(0, len(texts), 200):
        w, s, _ = encode(*utf8(pa.array(texts[k : k + 200], pa.large_string())))
        words.append(w)
        starts.append(s + at)
        at += len(w)
    return np.concatenate(words), np.concatenate(starts)


def pooled(model_tables, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Largest response of each filter in each document."""
    out = []
    n = len(words)
    for width, table in zip(WIDTHS, model_tables):
        total = table[0][words]
        for j in range(1, width):
            total[: n - j] += table[j][words[j:]]
        out.append(np.maximum.reduceat(total, starts, axis=0))
    return np.concatenate(out, 1)


def logits(model: Cnn, tables, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.maximum(pooled(tables, words, starts) + model.bias, 0) @ model.out + model.base


def fit(texts: list[str], toxic: list[int], epochs: int = EPOCHS) -> Cnn:
    """A model from labelled texts, with thresholds of 0."""
    rng = np.random.default_rng(5)
    size = 1 << BITS
    share = float(np.mean(toxic)) if toxic else 0.0
    base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    width = FILTERS * len(WIDTHS)
    model = Cnn(
        rng.normal(0, 0.1, (size, DIM)),
        [rng.normal(0, 0.3, (k, DIM, FILTERS)) for k in WIDTHS],
        np.zeros(width),
        rng.normal(0, 0.1, width),
        base,
        np.zeros(len(LANGUAGES)),
    )
    y = np.array(toxic, float)
    if len(set(toxic)) < 2:
        model.out[:] = 0
        return model
    words, starts = _encode_all(texts)
    ends = np.append(starts[1:], len(words))
    train = np.arange(len(y))
    seen = np.zeros((2, size))
    for d in train:
        seen[int(y[d]), np.unique(words[starts[d] : ends[d]])] += 1
    totals = np.array([np.sum(y == 0), np.sum(y == 1)])
    odds = np.log((seen[1] + 0.5) / (totals[1] + 1)) - np.log((seen[0] + 0.5) / (totals[0] + 1))
    model.embedding[:, 0] = np.clip(odds, -2, 3) * (seen.sum(0) > 1)
    model.embedding[0] = 0
    model.kernels[0][0, 0] = np.abs(model.kernels[0][0, 0]) + 0.3
    model.out[:FILTERS] = np.abs(model.out[:FILTERS])
    dense = [*model.kernels, model.bias, model.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in dense]
    squares = np.full((size, 1), 1e-4)
    step, base_slope = 0, 0.0
    for _ in range(epochs):
        rng.shuffle(train)
        for i in range(0, len(train), BATCH):
            step += 1
            slopes = [np.zeros_like(p) for p in dense]
            touched, pulls = [], []
            tops = np.zeros((min(BATCH, len(train) - i), width))
            wins = []
            part = train[i : i + BATCH]
            for r, d in enumerate(part):
                w = words[starts[d] : ends[d]]
                x = model.embedding[w]
                won = []
                for f, (k, kernel) in enumerate(zip(WIDTHS, model.kernels)):
                    n = len(w) - k + 1
                    total = x[:n] @ kernel[0]
                    for j in range(1, k):
                        total += x[j : n + j] @ kernel[j]
                    best = total.argmax(0)
                    won.append(best)
                    tops[r, f * FILTERS : (f + 1) * FILTERS] = total[best, np.arange(FILTERS)]
                wins.append((w, won))
            active = tops + model.bias > 0
            hidden = np.where(active, tops + model.bias, 0)
            p = 1 / (1 + np.exp(-(hidden @ model.out + model.base)))
            error = (p - y[part]) / len(part)
            slopes[-1] += hidden.T @ error
            back = error[:, None] * model.out * active
            slopes[-2] += back.sum(0)
            base_slope = error.sum()
            for r, (w, won) in enumerate(wins):
                for f, k in enumerate(WIDTHS):
                    g = back[r, f * FILTERS : (f + 1) * FILTERS]
                    for j in range(k):
                        at = w[won[f] + j]
                        slopes[f][j] += model.embedding[at].T * g
                        touched.append(at)
                        pulls.append(g[:, None] * model.kernels[f][j].T)
            for p_, g, (m, v) in zip(dense, slopes, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p_ -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            model.base -= RATE * base_slope
            at, pull = np.concatenate(touched), np.concatenate(pulls)
            kinds, inverse = np.unique(at, return_inverse=True)
            total = np.zeros((len(kinds), DIM))
            np.add.at(total, inverse, pull)
            squares[kinds] += (total**2).mean(1, keepdims=True)
            model.embedding[kinds] -= RATE * total / np.sqrt(squares[kinds])
            model.embedding[0] = 0
    return model


def set_thresholds(model: Cnn, cells: list[tuple[int, int, int, int]]) -> None:
    """Thresholds from counts of (language, label, logit in bins, rows)."""
    langs, y, bins, n = np.array(cells, np.int64).reshape(-1, 4).T
    overall = _threshold(bins / GRID, y, n)
    for k in range(len(LANGUAGES)):
        own = langs == k
        enough = min(n[own & (y == 1)].sum(), n[own & (y == 0)].sum()) >= 10
        model.thresholds[k] = _threshold(bins[own] / GRID, y[own], n[own]) if enough else overall


def _threshold(scores: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The middle of the gap below the cut with the largest F1, where each score stands for ``n``
    rows; 0 where one label is missing."""
    toxic = n[y == 1].sum()
    if not 0 < toxic < n.sum():
        return 0.0
    order = np.argsort(-scores, kind="stable")
    s, hits, taken = scores[order], np.cumsum((y * n)[order]), np.cumsum(n[order])
    f1 = 2 * hits / (taken + toxic)
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float(s[k] if k + 1 == len(s) else (s[k] + s[k + 1]) / 2)


def _scored(column: pa.Array, model: Cnn, tables):
    """Runs of texts, from i to j, with their languages and logits."""
    data, offsets = utf8(column)
    for i, j in slices(offsets, CHUNK_BYTES):
        words, starts, langs = encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, j, langs, logits(model, tables, words, starts)


def _part() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(PARTS)).cast("int")


def _logit_cells(docs: DataFrame, labels: DataFrame, models: dict[int, Cnn]) -> list[tuple[int, int, int, int]]:
    """Labelled rows by language, label and bin of the logit under the model of their part. Texts are
    scored where they are read; what meets the labels is an id, a language and a bin."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def work(batches):
        ready = {}
        for batch in batches:
            parts = batch.column(2).to_numpy(zero_copy_only=False)
            for part in np.unique(parts):
                model = shared.value[part]
                if part not in ready:
                    ready[part] = model.tables()
                own = batch.filter(pa.array(parts == part))
                for i, j, langs, out in _scored(own.column(1), model, ready[part]):
                    bins = np.round(np.clip(out, -100, 100) * GRID).astype(np.int64)
                    columns = [own.column(0).slice(i, j - i), pa.array(langs), pa.array(bins)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "bin"])

    rows = docs.select("doc_id", "text", _part().alias("part")).where(F.col("part").isin([*models]))
    cells = rows.mapInArrow(work, "doc_id long, lang long, bin long").join(labels, "doc_id")
    return [tuple(r) for r in cells.groupBy("lang", "toxic", "bin").count().collect()]


def _sample(docs: DataFrame, labels: DataFrame) -> list:
    """Texts, labels and parts of the rows to learn from. They are chosen by ids, hashes and lengths;
    then the texts of at most 2 * ``PER_CLASS`` rows are picked where they are read."""
    facts = docs.select("doc_id", F.xxhash64("text").alias("h"), F.least(F.length("text"), F.lit(TEXT_CHARS)).alias("chars"))
    order = W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "h")
    chosen = (
        facts.join(labels, "doc_id")
        .withColumn("k", F.row_number().over(order))
        .where(F.col("k") <= PER_CLASS)
        .withColumn("sum", F.sum("chars").over(W.partitionBy("toxic").orderBy("k")))
        .where(F.col("sum") <= CLASS_CHARS)
        .select("doc_id", "h", "toxic", "k")
        .collect()
    )
    spark = docs.sparkSession
    rows = spark.createDataFrame(chosen, "doc_id long, h long, toxic int, k int")
    spare = F.greatest(F.length("text") - TEXT_CHARS, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("doc_id", F.lit("window")), spare).cast("int") + 1
    found = docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(rows), ["doc_id", "h"])
    window = F.substring("text", start, F.lit(TEXT_CHARS)).alias("text")
    texts = found.select(window, "toxic", _part().alias("part"), "k").dropDuplicates(["toxic", "k"])
    return sorted(texts.collect(), key=lambda r: (r["k"], r["toxic"]))


def fit_on(docs: DataFrame, labels: DataFrame) -> Cnn:
    """A model from a bounded sample of the rows of ``docs`` (doc_id, text) that have a label in
    ``labels`` (doc_id, toxic), with thresholds from all of them, each under a model fitted
    without it."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.length("text") > 0)
    labels = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(F.col("toxic").isin(0, 1))
    rows = _sample(docs, labels)
    model = fit([r["text"] for r in rows], [r["toxic"] for r in rows])
    models = {}
    for part in range(PARTS):
        rest = [r for r in rows if r["part"] != part]
        if len({r["toxic"] for r in rest}) == 2:
            models[part] = fit([r["text"] for r in rest], [r["toxic"] for r in rest])
    if models:
        set_thresholds(model, _logit_cells(docs, labels, models))
    return model


def score(docs: DataFrame, model: Cnn, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    docs = docs.drop("score", "predicted")
    place = docs.columns.index(text)
    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    schema = T.StructType([*docs.schema.fields, *new])
    shared = docs.sparkSession.sparkContext.broadcast((model, model.tables()))

    def work(batches):
        model, tables = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, langs, found in _scored(batch.column(place), model, tables):
                out[i:j] = found - model.thresholds[langs]
            p = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
            columns = [*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(work, schema)
