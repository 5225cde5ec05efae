"""Spelling variants, merge replay and ranked search beside brute force, on odd rows too."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.errors import PySparkException

from rubrika.llm import catalog, edit_tiles, max_sketches, merge_replay, token_files
from tests.llm.test_llm_operators import empty, odd_documents

SF_DIR = "/root/testdata/sf0.001"


# --- merge replay ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merge_replay.read_ranks(), special_tokens={}
    )


def odd_texts(count, seed=5):
    rng = np.random.default_rng(seed)
    few = list("aaabcs't  \n\t.,1٣é漢😀 　\U00031350ᲊİ<|>lvermd'")
    for k in range(count):
        size = int(rng.integers(0, 60))
        if k % 3 == 0:
            yield "".join(rng.choice(few, size))
        elif k % 3 == 1:
            yield "".join(rng.choice(list("the andingst"), size))
        else:
            codes = rng.integers(32, 0x110000, size)
            yield "".join(chr(c) for c in codes if not 0xD800 <= c < 0xE000)


def encoded(work, texts):
    for ids, bounds in merge_replay.encode_column(work, pa.array(texts, pa.large_string())):
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield ids[a:b].tolist()


def test_ids_are_the_librarys(library):
    work = merge_replay.worker(merge_replay.RANKS)
    texts = [*odd_texts(6000), "a" * 999, " " * 500 + "x", "\n" * 99, "<|endoftext|>", "", "word " * 300_000]
    assert list(encoded(work, texts)) == library.encode_ordinary_batch(texts)


def test_windows_never_cut_a_piece():
    split = merge_replay.worker(merge_replay.RANKS).splitter
    for text in [*odd_texts(400, 7), "don't we've 's're  x", "a" * 100]:
        whole = [p for found in split.pieces(text) for p in found]
        assert "".join(whole) == text
        for window in (1, 2, 3, 5, 11):
            assert [p for found in split.pieces(text, window) for p in found] == whole


def test_a_rank_that_has_passed():
    """Ranks out of the order of learning: 'abc' comes before 'bc', so bc makes a pair that has passed."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"aa", b"bc", b"ab" * 2, b"bcbc", b"ca"]
    work = merge_replay.Replay({t: k for k, t in enumerate(tokens)})
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abc"), int(rng.integers(1, 12)))).encode() for _ in range(3000)]
    flat, bounds = work.replay(words)
    for word, a, b in zip(words, bounds, bounds[1:]):
        assert flat[a:b].tolist() == work.merge_alone(word)


def test_memory_of_pieces_may_run_out(library, monkeypatch):
    monkeypatch.setattr(merge_replay, "MEMO_BYTES", 1000)
    monkeypatch.setattr(merge_replay, "BLOCK_BYTES", 50)
    monkeypatch.setattr(merge_replay, "WINDOW", 64)
    work = merge_replay.Replay(merge_replay.read_ranks())
    work.splitter = merge_replay.Splitter()
    texts = list(odd_texts(300, 9))
    assert list(encoded(work, texts)) == library.encode_ordinary_batch(texts)


def test_replay_of_tables(spark, library):
    docs = odd_documents(spark)
    rows = merge_replay.ids_digest(merge_replay.decode(merge_replay.encode(docs))).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = []
    for key, text in texts:
        ids = library.encode_ordinary(text)
        want.append((str(key), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), text.encode()))
    found = [(str(r["doc_id"]), r["ids"], r["ids_sha256"], bytes(r["decoded"])) for r in rows]
    assert sorted(found) == sorted(want)
    assert merge_replay.decode(merge_replay.encode(empty(spark))).count() == 0
    other = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in merge_replay.decode(other).orderBy("doc_id").collect()] == [None, b""]
    with pytest.raises(PySparkException):
        merge_replay.decode(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>")).collect()


def test_replay_query(spark, library):
    found = {r["doc_id"]: r for r in catalog.QUERIES["op12_merge_replay"](spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert len(found) == len(docs)
    for doc in docs:
        ids = library.encode_ordinary(doc["text"] or "")
        row = found[doc["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((doc["text"] or "").encode()).hexdigest()


# --- ranked search -----------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, top):
    bags = [(key, terms_of(text)) for key, text in docs]
    bags = [(key, Counter(t), len(t)) for key, t in bags if t]
    n_docs, n_all = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    found = []
    for item, text in items:
        scored = []
        for key, bag, n in bags:
            m = 100 - 25 + 25 * n * n_docs // n_all
            score = 0
            for t in terms_of(text):
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m))
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        found += [(item, k + 1, key, -s) for k, (s, _, _, key) in enumerate(sorted(scored)[:top])]
    return found


def same(rows, want):
    return sorted(map(repr, [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows])) == sorted(map(repr, want))


def test_search_beside_all_scores(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(300)] + ["Été", "a_b", "x9"]
    share = 1 / np.arange(1, len(words) + 1)
    docs = []
    for k in range(500):
        size = int(rng.choice([0, 1, 3, 30, 200]))
        docs.append((k, " ".join(rng.choice(words, size, p=share / share.sum()))))
    docs += docs[:40] + [(None, docs[50][1]), (900, docs[50][1].upper()), (901, None), (902, "--- !")]
    items = [(k, " ".join(rng.choice(words, int(rng.integers(1, 25))))) for k in range(30)]
    items += [items[3], (None, "w1 w1 w1"), (70, None), (71, ""), (72, "nowhere"), (73, "W0 é")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute_search(docs, items, 7)
    assert same(max_sketches.search(table, asked, 7).collect(), want)
    monkeypatch.setattr(max_sketches, "QUERIES", 4)
    assert same(max_sketches.search(table, asked, 7).collect(), want)


def test_search_of_odd_rows(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame(
        [(1, "two five", "x"), (2, "wort B", "y"), (None, None, None)], "item_id long, text string, doc_id string"
    )
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_search(texts, [(1, "two five"), (2, "wort B")], 20)
    assert same(max_sketches.search(docs, items).collect(), want)
    assert max_sketches.search(empty(spark), items).count() == 0
    assert max_sketches.search(docs, empty(spark, "item_id long, text string")).count() == 0


def test_bounds_hold_and_are_rarely_passed(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    n_docs, n_all = max_sketches.sizes(docs)
    index = max_sketches.build_index(docs, n_docs, n_all).toArrow().combine_chunks().to_batches()[0]
    block = max_sketches.Block([(r["item_id"], r["text"]) for r in items])
    held = max_sketches.Documents(index)
    df = Counter(np.searchsorted(block.hashes, held.terms[np.isin(held.terms, block.hashes)]).tolist())
    block.weigh(df, n_docs)
    every, done = np.arange(index.num_rows), 0
    for terms, weights in zip(block.terms, block.weights):
        h = block.hashes[terms]
        bound = weights.astype(np.float64) @ held.bounds(h) * max_sketches.ROUND
        exact = held.scores(every, h, weights)
        assert (bound >= exact).all()
        best = max_sketches.Best(20)
        done += max_sketches.rescore(held, bound, best, h, weights)
        assert best.scores.tolist() == sorted(exact[exact > 0].tolist(), reverse=True)[:20]
    assert done < 0.6 * len(items) * index.num_rows


# --- spelling variants ---------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    found = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        found.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return found


def all_of(rows):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("limit", [2, 8, 512])
def test_variants_beside_all_pairs(spark, limit):
    """Graded edits of few words, so that groups are large and are split down to one open place."""
    rng = np.random.default_rng(11)
    counts = {}
    for base in ("aaaaaa", "aaaaaaaa", "abcabcabc", "éàüöñç", "internation", "q" * 40):
        for _ in range(60):
            word = list(base)
            for _ in range(int(rng.integers(0, 3))):
                at, kind = int(rng.integers(0, len(word))), int(rng.integers(0, 3))
                letter = str(rng.choice(list("abcé")))
                word[at : at + (kind != 0)] = [letter] if kind != 1 else []
            counts["".join(word)] = int(5 ** rng.integers(1, 5)) + int(rng.integers(0, 3))
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert all_of(edit_tiles.variants(words, limit).collect()) == brute_variants(counts)


def test_no_group_is_over_the_limit(spark):
    words = spark.createDataFrame([(f"common{a}{b}{c}", 5) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"], "word string, n long")
    rows = edit_tiles.groups(words, 16)
    sizes = rows.groupBy(*edit_tiles.KEYS).count().where("high - low > 1 AND count > 16")
    assert sizes.isEmpty()


def test_roots_of_long_chains(spark):
    steps = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(20)], "word string, root string")
    assert {r["root"] for r in edit_tiles.roots(steps).collect()} == {"w20"}


def brute_counts(docs):
    total = Counter()
    for key, text in docs:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if n >= 5 and len(w) >= 6}


def test_counts_of_damaged_words(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = ["Straßen", "ÉCOLES", "garçons", "ordinary", "x" * 70, "short"]
    docs = [(int(rng.integers(0, 400)), " ".join(rng.choice(words, 12))) for _ in range(600)] + [(None, "ordinary " * 9)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute_counts(docs)
    assert len(want) > len(words)
    assert {r["word"]: r["n"] for r in edit_tiles.count_words(table).collect()} == want
    monkeypatch.setattr(edit_tiles, "HELD_WORDS", 2)
    monkeypatch.setattr(edit_tiles, "LONG_TEXT", 20)
    assert {r["word"]: r["n"] for r in edit_tiles.count_words(table).collect()} == want


def test_variants_of_odd_rows(spark):
    docs = odd_documents(spark)
    words = edit_tiles.count_words(docs)
    assert {r["word"]: r["n"] for r in words.collect()} == brute_counts([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert edit_tiles.variants(edit_tiles.count_words(empty(spark))).count() == 0


def test_long_documents_train_the_dictionary(spark):
    words = "the night train to the coast was late again and nobody on the platform seemed to mind".split()
    texts = [" ".join(words[(i * k + k // 7) % len(words)] for k in range(8000)) for i in range(1, 41)]
    assert min(map(len, texts)) > token_files.SAMPLE_CHARS
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    dictionary = token_files.train_dictionary(docs.union(docs.limit(1)))
    assert len(dictionary) >= 1024
    assert dictionary == token_files.train_dictionary(docs.repartition(3))
    assert token_files.train_dictionary(docs.limit(0)) == b""
