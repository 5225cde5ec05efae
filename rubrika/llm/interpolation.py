"""Scores of texts under a language model with deleted interpolation.

The probability of a word after another mixes three maximum-likelihood estimates: of the pair, of the
word, and the uniform one over the V known words and one unknown:

    P(w | v) = a * c(v, w) / c(v) + b * c(w) / N + (1 - a - b) / (V + 1)

The weights a and b depend on the bucket of the context's frequency, floor(log2 c(v)) + 1 (0: unseen,
a = 0). They are learned by expectation-maximisation on held-out counts: each occurrence in the
training texts is predicted from the counts without itself. A text starts after an end mark and
closes with one.

Counts cover all training texts and are spread over buckets of hashes. Texts are kept in chunks of
some MB, written bucketed by chunk, so later passes find them in place. For each chunk and bucket one
packed message carries the distinct words (then pairs) with their training counts; the bucket's task
adds up all messages and answers each with the total counts. A frequent word thus is one entry per
chunk. Pairs with a word that occurs once in all texts need no message: their count is known.

Words have 64-bit and pairs 56-bit hashes.

Cases: null and empty texts are an end mark alone; null ids are scored and belong to the fold of the
empty text; repeated rows count as often as they occur; without training texts N = V = 0 and every
token has the uniform probability 1; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrika.llm.common import shuffle_partitions, stored, utf8
from rubrika.llm.words import find, hashes, mix
from rubrika.session import shared_folder

CHUNK_BYTES = 6 << 20
END = np.uint64(0x5851F42D4C957F2D)
BUCKETS = 40  # of context frequencies
ITERATIONS = 30
GRID = 8  # bins per power of two of the held-out ratios
BINS = 512  # more than the bins below 0
MESSAGE = "bucket int, chunk long, keys binary, counts binary"
ANSWER = "chunk long, kind int, bucket int, counts binary"


def _chunk_rows(batches):
    from pyspark import TaskContext

    number, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        _, offsets = utf8(batch.column(1))
        chunks = np.empty(batch.num_rows, np.int64)
        for k, n in enumerate(np.diff(offsets)):
            if size and size + n > CHUNK_BYTES:
                number, size = number + 1, 0
            chunks[k] = number
            size += int(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunks)], names=["doc_id", "text", "train", "chunk"])


def _chunk_table(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.mapInArrow(_chunk_rows, "doc_id string, text string, train boolean, chunk long")
    name = f"rubrika_chunks_{uuid4().hex}"
    (
        rows.write.format("parquet")
        .option("compression", "zstd")
        .option("path", shared_folder(spark, "chunks"))
        .bucketBy(shuffle_partitions(spark), "chunk")
        .saveAsTable(name)
    )
    return spark.table(name)


class Chunk:
    """Tokens of a chunk's documents: the words of each and an end mark."""

    def __init__(self, rows: pd.DataFrame):
        data, offsets = utf8(pa.array([t or "" for t in rows["text"]], pa.large_string()))
        starts, ends, counts = find(data, offsets)
        self.counts = counts + 1
        self.last = np.cumsum(self.counts) - 1
        self.tokens = np.full(int(self.counts.sum()), END)
        inner = np.ones(len(self.tokens), bool)
        inner[self.last] = False
        self.tokens[inner] = hashes(data, starts, ends)
        self.train = np.repeat(rows["train"].to_numpy(bool), self.counts)
        self.words, self.of = np.unique(self.tokens, return_inverse=True)
        # The word before each token; texts start after an end mark.
        end = int(np.searchsorted(self.words, END)) if len(self.words) else 0
        self.before = np.empty(len(self.of), np.int64)
        self.before[1:] = self.of[:-1]
        if len(self.of):
            self.before[np.concatenate(([0], self.last[:-1] + 1))] = end

    def pairs(self, repeated: np.ndarray):
        """Distinct pairs of words that both occur more than once in all texts, and the pair of
        each token (-1 for others)."""
        asked = repeated[self.of] & repeated[self.before]
        key = mix(self.words[self.before[asked]] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.of[asked]])
        kinds, inverse = np.unique(key & np.uint64((1 << 56) - 1), return_inverse=True)
        of = np.full(len(self.of), -1)
        of[asked] = inverse
        return kinds, of


def _cut(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Borders of the buckets in sorted keys: equal ranges of hashes."""
    width = -(-(1 << bits) // buckets)
    return np.searchsorted(keys, np.array([min(k * width, (1 << bits) - 1) for k in range(buckets)] , np.uint64)).tolist() + [len(keys)]


def _squeeze(keys: np.ndarray, width: int) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _widen(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _messages(chunk: int, keys: np.ndarray, counts: np.ndarray, bits: int, buckets: int) -> pd.DataFrame:
    cut = _cut(keys, bits, buckets)
    some = [k for k in range(buckets) if cut[k] < cut[k + 1]]
    return pd.DataFrame(
        {
            "bucket": pd.Series(some, dtype="int32"),
            "chunk": pd.Series(chunk, index=range(len(some)), dtype="int64"),
            "keys": [_squeeze(keys[cut[k] : cut[k + 1]], bits // 8) for k in some],
            "counts": [counts[cut[k] : cut[k + 1]].astype("<u4").tobytes() for k in some],
        }
    )


def _word_messages(buckets: int):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(rows)
        both = np.minimum(np.bincount(c.of, minlength=len(c.words)), 2)
        train = np.bincount(c.of[c.train], minlength=len(c.words))
        # The lowest two bits say whether the word occurs once or more in this chunk.
        return _messages(int(rows["chunk"].iloc[0]), c.words, train << 2 | both, 64, buckets)

    return work


def _add_up(width: int, marks: bool, kind: int):
    """Totals of a bucket, as an answer to each message; chunk -1 has the sum and the number of
    keys that occur in training."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [_widen(x, width) for x in rows["keys"]]
        counts = [np.frombuffer(x, "<u4").astype(np.int64) for x in rows["counts"]]
        flat, values = np.concatenate(keys), np.concatenate(counts)
        kinds, inverse = np.unique(flat, return_inverse=True)
        train = values >> 2 if marks else values
        total = np.bincount(inverse, train, len(kinds)).astype(np.int64)
        answer = total
        if marks:
            answer = total << 1 | (np.bincount(inverse, values & 3, len(kinds)) > 1)
        out = answer[inverse]
        borders = np.cumsum([0, *map(len, keys)])
        parts = [out[a:b].astype("<i8").tobytes() for a, b in zip(borders[:-1], borders[1:])]
        bucket = int(rows["bucket"].iloc[0])
        summary = np.array([total.sum(), (total > 0).sum()], "<i8").tobytes()
        return pd.DataFrame(
            {
                "chunk": pd.Series([*rows["chunk"], -1], dtype="int64"),
                "kind": pd.Series([kind] * (len(rows) + 1), dtype="int32"),
                "bucket": pd.Series([bucket] * (len(rows) + 1), dtype="int32"),
                "counts": [*parts, summary],
            }
        )

    return work


def _answers(rows: pd.DataFrame, kind: int) -> np.ndarray:
    own = rows[rows["kind"] == kind].sort_values("bucket")
    return np.frombuffer(b"".join(own["counts"]), "<i8")


def _pair_messages(buckets: int):
    def work(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(rows)
        kinds, of = c.pairs((_answers(answers, 1) & 1).astype(bool))
        used = c.train & (of >= 0)
        return _messages(int(rows["chunk"].iloc[0]), kinds, np.bincount(of[used], minlength=len(kinds)), 56, buckets)

    return work


class Counted(Chunk):
    """A chunk with the training counts of its tokens, contexts and pairs."""

    def __init__(self, rows: pd.DataFrame, answers: pd.DataFrame):
        super().__init__(rows)
        words = _answers(answers, 1)
        kinds, of = self.pairs((words & 1).astype(bool))
        total = np.append(_answers(answers, 2), 0)
        count = words >> 1
        self.word, self.context = count[self.of], count[self.before]
        # A pair that nobody asks for has a word that occurs once in all texts: here.
        self.pair = np.where(of >= 0, total[of], self.train.astype(np.int64))


def frequency_bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def _held_out(n: int, v: int):
    """Counts of (context bucket, pair ratio, word ratio) over training tokens, each predicted
    without itself."""
    spec = {"bucket": "int32", "pair": "int32", "word": "int32", "n": "int64"}

    def work(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        c = Counted(rows, answers)
        t = c.train
        context, word, pair = c.context[t] - 1, c.word[t] - 1, c.pair[t] - 1
        # A cell in one number; bins go from -GRID * 60 to 1.
        ratios = _bin(pair / np.maximum(context, 1)) + BINS << 10 | _bin(word / max(n - 1, 1)) + BINS
        cells, counts = np.unique(frequency_bucket(context) << 20 | ratios, return_counts=True)
        return pd.DataFrame(
            {"bucket": cells >> 20, "pair": (cells >> 10 & 1023) - BINS, "word": (cells & 1023) - BINS, "n": counts}
        ).astype(spec)

    return work


def _bin(p: np.ndarray) -> np.ndarray:
    """Bins of a probability: 1 for impossible, else powers of 2 ^ (-1 / GRID) from 0 down."""
    return np.where(p > 0, np.round(GRID * np.log2(np.maximum(p, 1e-18))), 1).astype(np.int64)


def _unbin(k: np.ndarray) -> np.ndarray:
    return np.where(k > 0, 0.0, np.exp2(k / GRID))


def learn_weights(cells: pd.DataFrame, v: int) -> np.ndarray:
    """Weights of pair, word and uniform estimate for each context bucket, by EM."""
    weights = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    # Buckets without held-out tokens get the weights of all tokens together.
    everything = cells.assign(bucket=-1)
    overall = np.array([0.3, 0.6, 0.1])
    for bucket, part in [(-1, everything), *cells.groupby("bucket")]:
        if not len(part):
            continue
        w = np.array([0.4, 0.5, 0.1]) if bucket else np.array([0.0, 0.9, 0.1])
        p = np.stack([_unbin(part["pair"].to_numpy()), _unbin(part["word"].to_numpy()), np.full(len(part), 1 / (v + 1))], 1)
        n = part["n"].to_numpy(float)
        for _ in range(ITERATIONS):
            share = p * w
            share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
            w = (share * n[:, None]).sum(0) / n.sum()
        w = (w + 1e-6) / (w + 1e-6).sum()
        if bucket < 0:
            overall = w
            weights[1:] = overall
        else:
            weights[bucket] = w
    weights[0, 1:] += weights[0, 0] / 2
    weights[0, 0] = 0.0
    return weights


SCORED = "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(n: int, v: int, weights: np.ndarray):
    def work(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        c = Counted(rows, answers)
        w = weights[frequency_bucket(c.context)]
        p = (
            w[:, 0] * c.pair / np.maximum(c.context, 1)
            + w[:, 1] * c.word / max(n, 1)
            + w[:, 2] / (v + 1)
        )
        base = np.log10((c.word + 1) / (n + v + 1))
        heads = c.last - c.counts + 1
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"].array,
                "held_out": ~rows["train"].to_numpy(bool),
                "n_tokens": c.counts,
                "n_known": np.add.reduceat((c.word > 0).astype(np.int64), heads),
                "base_score": np.add.reduceat(base, heads),
                "score": np.add.reduceat(np.log10(p), heads),
            }
        )

    return work


def score(docs: DataFrame, is_training: Column) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of
    ``docs`` (doc_id, text), with counts from the rows of which ``is_training`` holds."""
    rows = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), is_training.alias("train")
    )
    chunks = _chunk_table(rows)
    buckets = shuffle_partitions(docs.sparkSession)
    by_chunk = chunks.groupBy("chunk")
    words = by_chunk.applyInPandas(_word_messages(buckets), MESSAGE)
    words = stored(words.groupBy("bucket").applyInPandas(_add_up(8, True, 1), ANSWER), "word-counts")
    summary = words.where("chunk = -1").select("counts").collect()  # a row per bucket
    sums = sum((np.frombuffer(r["counts"], "<i8") for r in summary), np.zeros(2, np.int64))
    n, v = int(sums[0]), int(sums[1])
    asked = words.where("chunk >= 0")
    pairs = by_chunk.cogroup(asked.groupBy("chunk")).applyInPandas(_pair_messages(buckets), MESSAGE)
    pairs = stored(pairs.groupBy("bucket").applyInPandas(_add_up(7, False, 2), ANSWER), "pair-counts")
    answers = asked.union(pairs.where("chunk >= 0"))
    cells = (
        by_chunk.cogroup(answers.groupBy("chunk"))
        .applyInPandas(_held_out(n, v), "bucket int, pair int, word int, n long")
        .groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n"))
        .toPandas()  # at most BUCKETS x 500 x 500 cells, some thousands in practice
    )
    weights = learn_weights(cells, v)
    scored = by_chunk.cogroup(answers.groupBy("chunk")).applyInPandas(_score(n, v, weights), SCORED)
    # Ids travel as text, as pandas has no whole numbers with nulls.
    return scored.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("train_tokens", F.lit(n).cast("long"))
