"""Language of words and texts with a linear-chain conditional random field.

Each word is labelled with a language. Its features are hashed: the first and last one to three
bytes (affixes), all runs of three bytes (n-grams) and the whole word (lexicon). Transition weights
between labels are learned with them, by gradient steps on the exact log-likelihood, from sequences
that put pieces of documents of several languages one after another, so that they hold switches.
Forward-backward gives each word its label probabilities; a text's language has the largest mean
probability over the words with letters, and that mean is its score.

Long texts are cut into segments of ``SEGMENT`` words whose transfer matrices are multiplied first;
this gives the same probabilities as one chain over the whole text.

The fit uses at most ``PER_LANGUAGE`` labelled rows of each of ``LANGUAGES`` languages, the first by
a hash of their id, of any length; of a text of more than ``SAMPLE_CHARS`` characters it reads a
window of so many, at a place that a hash of the id chooses.

Cases: null texts and texts without a letter are ``und`` with score 0; without any usable labelled
row all texts are ``und``; null language labels are not learned; ties go to the language first by
code point; rows pass one by one, repeated or not, with their other columns; the result's columns
replace columns of the same names; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubrika.llm.common import slices, utf8
from rubrika.llm.words import LETTER, LOWER, cores, find, mix, span_hashes

BITS = 17
SEGMENT = 128
PER_LANGUAGE = 250
LANGUAGES = 64
SAMPLE_CHARS = 12_000
ROUNDS = 12
RATE = 0.5
CHUNK_BYTES = 2 << 20
UNKNOWN = "und"


@dataclass
class Crf:
    """Labels in code point order, weights of features per label, and of transitions."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray):
    """Feature numbers and the word of each, for distinct words."""
    mask = np.uint64((1 << BITS) - 1)
    low = LOWER[data].astype(np.uint64)
    words = np.arange(len(starts))
    numbers, owners = [], []

    def add(kind: int, code: np.ndarray, owner: np.ndarray) -> None:
        numbers.append((mix(code + np.uint64(kind << 40)) & mask).astype(np.int64))
        owners.append(owner)

    for k in (1, 2, 3):
        w = words[ends - starts >= k]
        for kind, at in ((k, starts[w]), (3 + k, ends[w] - k)):
            code = np.zeros(len(w), np.uint64)
            for j in range(k):
                code = code << np.uint64(8) | low[at + j]
            add(kind, code, w)
    counts = np.maximum(ends - starts - 2, 0)
    owner = np.repeat(words, counts)
    at = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    if len(at):
        add(7, low[at] << np.uint64(16) | low[at + 1] << np.uint64(8) | low[at + 2], owner)
    some = ends > starts
    add(8, whole[some], words[some])
    return np.concatenate(numbers), np.concatenate(owners)


class Words:
    """Words of a run of documents, with the features of the distinct ones."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.counts = find(data, offsets)
        begin, end = cores(data, starts, ends)
        h = span_hashes(data, begin, end)
        _, first, self.kind = np.unique(h, return_index=True, return_inverse=True)
        self.lettered = end > begin
        self.number, self.owner = _features(data, begin[first], end[first], h[first])
        self.distinct = len(first)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        columns = [np.bincount(self.owner, weights[self.number, k], self.distinct) for k in range(weights.shape[1])]
        return np.stack(columns, 1)[self.kind]


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)


def marginals(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Label probabilities of each word of each sequence; with ``pairs`` also the expected number
    of each transition. ``scores``: words by labels; ``counts``: words of each sequence."""
    n, labels = scores.shape
    if not n:
        return (scores, np.zeros((labels, labels))) if pairs else scores
    e = np.exp(scores - scores.max(1, keepdims=True))
    t = np.exp(transitions - transitions.max())
    per = -(-counts // SEGMENT)
    sequence = np.repeat(np.arange(len(counts)), per)
    number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    begin = (np.cumsum(counts) - counts)[sequence] + number * SEGMENT
    length = np.minimum(counts[sequence] - number * SEGMENT, SEGMENT)
    order = np.argsort(-length, kind="stable")
    begin, length, sequence, number = begin[order], length[order], sequence[order], number[order]
    active = [int(np.searchsorted(-length, -k, side="left")) for k in range(SEGMENT)]
    steps = int(length[0])
    # Transfer matrices of segments, then what enters each from the left and from the right.
    total = np.broadcast_to(np.eye(labels), (len(begin), labels, labels)).copy()
    several = int(per.max()) > 1
    if several:
        for k in range(steps):
            a = active[k]
            step = (total[:a] @ t) * e[begin[:a] + k][:, None, :]
            total[:a] = step / np.maximum(step.max(axis=(1, 2), keepdims=True), 1e-300)
    into = np.full((len(begin), labels), 1.0 / labels)
    back = np.ones((len(begin), labels))
    if several:
        place = np.empty(len(begin), np.int64)
        firsts = np.cumsum(per) - per
        place[firsts[sequence] + number] = np.arange(len(begin))
        for k in range(1, int(per.max())):
            here = firsts[per > k] + k
            left, own = place[here - 1], place[here]
            into[own] = _normal(np.einsum("si,sij->sj", into[left], total[left]))
        for k in range(int(per.max()) - 1, 0, -1):
            here = firsts[per > k] + k
            left, own = place[here - 1], place[here]
            back[left] = _normal(np.einsum("sij,sj->si", total[own], back[own]))
    forward = np.empty((n, labels))
    state = into.copy()
    for k in range(steps):
        a = active[k]
        state[:a] = _normal((state[:a] @ t) * e[begin[:a] + k])
        forward[begin[:a] + k] = state[:a]
    out = np.empty((n, labels))
    moves = np.zeros((labels, labels))
    state = back
    for k in range(steps - 1, -1, -1):
        a = active[k]
        at = begin[:a] + k
        out[at] = _normal(forward[at] * state[:a])
        after = e[at] * state[:a]
        if pairs:
            before = into[:a] if k == 0 else forward[at - 1]
            joint = before[:, :, None] * t[None] * after[:, None, :]
            moves += (joint / np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(0)
        state[:a] = _normal(after @ t.T)
    return (out, moves) if pairs else out


def fit(texts: list[str], langs: list[str], rounds: int = ROUNDS) -> Crf:
    """A model from labelled texts; the same texts give the same model."""
    labels = sorted(set(langs))
    model = Crf(labels, np.zeros((1 << BITS, len(labels)), np.float32), np.zeros((len(labels), len(labels))))
    if len(labels) < 2:
        return model
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    words = Words(data, offsets)
    truth = np.repeat([labels.index(x) for x in langs], words.counts)
    # Sequences with switches: pieces of documents in random order, several to a sequence.
    rng = np.random.default_rng(11)
    starts = np.cumsum(words.counts) - words.counts
    pieces = []
    for start, count in zip(starts, words.counts):
        at = 0
        while at < count:
            size = min(int(rng.integers(20, 200)), count - at)
            pieces.append((start + at, size))
            at += size
    rng.shuffle(pieces)
    order = np.concatenate([np.arange(s, s + c) for s, c in pieces])
    sizes = np.array([c for _, c in pieces])
    groups = [sizes[i : i + 4].sum() for i in range(0, len(sizes), 4)]
    counts = np.array(groups)
    truth, kind = truth[order], words.kind[order]
    words.kind = kind
    onehot = np.zeros((len(truth), len(labels)))
    onehot[np.arange(len(truth)), truth] = 1
    seen = np.zeros((len(labels), len(labels)))
    heads = np.cumsum(counts) - counts
    inner = np.ones(len(truth), bool)
    inner[heads] = False
    np.add.at(seen, (truth[np.flatnonzero(inner) - 1], truth[inner]), 1)
    np.add.at(seen, (slice(None), truth[heads]), 1.0 / len(labels))
    squares = np.full(model.weights.shape, 1e-8)
    squares_t = np.full(seen.shape, 1e-8)
    for _ in range(rounds):
        p, moves = marginals(words.emissions(model.weights), counts, model.transitions, pairs=True)
        for k in range(len(labels)):
            by_word = np.bincount(kind, onehot[:, k] - p[:, k], words.distinct)
            slope = np.bincount(words.number, by_word[words.owner], 1 << BITS) / len(truth)
            squares[:, k] += slope**2
            model.weights[:, k] += (RATE * slope / np.sqrt(squares[:, k])).astype(np.float32)
        slope = (seen - moves) / len(truth)
        squares_t += slope**2
        model.transitions += RATE * slope / np.sqrt(squares_t)
    return model


def fit_on(labelled: DataFrame) -> Crf:
    """A model from a bounded sample of ``labelled`` (doc_id, text, lang)."""
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    text = F.col("text").cast("string")
    spare = F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("doc_id", F.lit("window")), spare).cast("int") + 1
    rows = labelled.where(F.length("text") > 0).select(
        "doc_id", F.substring(text, start, F.lit(SAMPLE_CHARS)).alias("text"), F.col("lang").cast("string").alias("lang")
    ).where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN))
    rows = (
        rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= PER_LANGUAGE)
        .orderBy("k", "lang").limit(PER_LANGUAGE * LANGUAGES).select("text", "lang").collect()
    )
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def label_words(text: str, model: Crf) -> list[tuple[str, str, float]]:
    """The words of one text with their languages and probabilities."""
    data, offsets = utf8(pa.array([text], pa.large_string()))
    words = Words(data, offsets)
    p = marginals(words.emissions(model.weights), words.counts, model.transitions)
    starts, ends, _ = find(data, offsets)
    best = p.argmax(1) if len(p) else []
    raw = data.tobytes()
    return [
        (raw[a:b].decode("utf-8", "replace"), model.labels[k], float(q[k])) for a, b, k, q in zip(starts, ends, best, p)
    ]


def _predict(column, model: Crf):
    """Per text: language, score, share of words of each label and number of switches."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    pred, score = np.full(n, -1), np.zeros(n)
    shares, switches = np.zeros((n, len(model.labels))), np.zeros(n, np.int64)
    for i, j in slices(offsets, CHUNK_BYTES):
        part, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        words = Words(part, cut)
        if not len(words.kind) or not model.labels:
            continue
        p = marginals(words.emissions(model.weights), words.counts, model.transitions)
        doc = np.repeat(np.arange(j - i), words.counts)
        use = words.lettered
        number = np.bincount(doc[use], minlength=j - i)
        mean = np.stack([np.bincount(doc[use], p[use, k], j - i) for k in range(p.shape[1])], 1)
        mean /= np.maximum(number, 1)[:, None]
        best = p.argmax(1)
        change = (best[1:] != best[:-1]) & (doc[1:] == doc[:-1])
        switches[i:j] = np.bincount(doc[1:][change], minlength=j - i)
        shares[i:j] = mean
        pred[i:j] = np.where(number > 0, mean.argmax(1), -1)
        score[i:j] = np.where(number > 0, mean.max(1), 0.0)
        # Bytes beyond ASCII may be marks only: look closer where no ASCII letter is.
        plain = np.concatenate(([0], np.cumsum(LETTER[part] & (part < 128))))
        for k in np.flatnonzero((np.diff(plain[cut]) == 0) & (number > 0)):
            if not _has_letter(part[cut[k] : cut[k + 1]].tobytes()):
                pred[i + k], score[i + k] = -1, 0.0
    names = [*model.labels, UNKNOWN]
    shares = pa.array([dict(zip(model.labels, row)) for row in shares.round(4).tolist()], pa.map_(pa.string(), pa.float64()))
    return pa.array([names[k] for k in pred], pa.string()), pa.array(np.clip(score, 0, 1)), shares, pa.array(switches)


def predict(docs: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``shares`` (language to share of the words) and
    ``switches`` (changes of language between words)."""
    docs = docs.drop("lang_pred", "score", "shares", "switches")
    place = docs.columns.index(text)
    new = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("shares", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("switches", T.LongType()),
    ]
    schema = T.StructType([*docs.schema.fields, *new])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            columns = [*batch.columns, *_predict(batch.column(place), shared.value)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(work, schema)
