"""The training-data operators on small tables: brute force, round trips, odd rows."""

import zlib
from datetime import datetime

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rubrika.llm import (
    cap_filters,
    catalog,
    crf_language,
    interpolation,
    mixing,
    ngram_join,
    packing,
    permutation_index,
    pii,
    token_files,
    toxicity,
)
from rubrika.session import shared_folder
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, node string"


def odd_documents(spark):
    """Nulls in every column, empty, blank, long and repeated texts, and clashing column names."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [
        (1, base, "en", "a", 1, "x", "y"),
        (2, base.upper(), "en", "a", 1, "x", "y"),
        (2, base.upper(), "en", "a", 1, "x", "y"),
        (3, "", "de", "b", 0, None, None),
        (4, None, None, None, None, None, None),
        (None, base + " more", "fr", None, 3, "x", "y"),
        (6, " \n\t ", "en", "b", 3, "x", "y"),
        (7, "lang wort und noch ein wort " * 3000, "de", "c", 3, "x", "y"),
        (8, "a b", "en", "c", 3, "x", "y"),
        (9, "A  b", "en", "c", 3, "x", "y"),
        (10, "1234 5678 ***", "en", "c", 3, "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark, spec=DOCS):
    return spark.createDataFrame([], spec)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_reference_sql(spark, name):
    with connect(SF_DIR) as con:
        assert not differences(catalog.QUERIES[name](spark, SF_DIR), catalog.ORACLES[name], con)


# --- n-gram join ---------------------------------------------------------------------------------


def brute_components(texts):
    """Components by all pairs; equal ids are one document here."""
    sets = {}
    for key, text in texts:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        grams = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        sets[key] = grams
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return {k: (len(sets[k]), label[k]) for k in sets}


def test_join_of_random_edits(spark):
    """Sets of all sizes, light and heavy, in groups of near copies of graded likeness."""
    rng = np.random.default_rng(3)
    texts, key = [], 0
    for size in [1, 2, 5, 6, 7, 8, 9, 10, 11, 13, 16, 20, 30, 60, 150]:
        for _ in range(3):
            base = [f"w{x}" for x in rng.integers(0, 10**6, size)]
            for edits in (0, 0, 1, 1, 2, 4):
                words = list(base)
                for _ in range(edits):
                    words[int(rng.integers(0, len(words)))] = f"e{rng.integers(0, 10**6)}"
                texts.append((key, " ".join(words)))
                key += 1
    found = ngram_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(texts)


def test_join_of_odd_rows(spark):
    rows = ngram_join.near_duplicates(odd_documents(spark)).collect()
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in rows}
    assert len(rows) == 11
    assert found[(2, 10)] == 1 and found[(None, 11)] == 1
    assert found[(3, 0)] == 3 and found[(4, 0)] == 4 and found[(6, 0)] == 6
    assert found[(8, 1)] == 8 and found[(9, 1)] == 8
    assert ngram_join.near_duplicates(empty(spark)).count() == 0


def test_reach_is_the_largest_partner():
    for n in (*range(1, 60), 146, 997):
        reach = ngram_join.reaches(n)
        assert len(reach) == ngram_join.prefix_size(n)
        for place, most in enumerate(reach.tolist()):
            assert ngram_join.overlap(n, most) <= n - place < ngram_join.overlap(n, most + 1)


def test_boundary_follows_cost():
    assert ngram_join.light_boundary({}) == 0
    assert ngram_join.light_boundary({4: 1000}) >= 4
    assert ngram_join.light_boundary({24: 1000}) < 24


# --- mix -------------------------------------------------------------------------------------


def test_mix_of_odd_rows(spark):
    rows = mixing.mix(odd_documents(spark)).collect()
    assert len(rows) == 11
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    assert mixing.mix(empty(spark)).count() == 0


def test_mix_takes_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    taken = mixing.take_documents(docs)
    assert taken.columns == docs.columns
    words = {}
    for r in taken.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {k: v for k, v in plan.items() if v}


# --- packing and files -------------------------------------------------------------------------


def expected_ids(name, text, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_packing_keeps_every_id_once(spark):
    docs = odd_documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    pieces = packing.pack(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for key, text in texts.items():
        own = sorted((p for p in pieces if p["doc_id"] == key), key=lambda p: p["start"])
        raw = b"".join(p["ids"] for p in own)
        assert np.frombuffer(raw, "<u4").tolist() == expected_ids("byte_bpe_50k.json", text, 1)
        assert [p["start"] for p in own] == np.cumsum([0, *[p["length"] for p in own]])[:-1].tolist()
    windows = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for window in windows.values():
        at = 0
        for offset, length in sorted(window):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty(spark)).count() == 0


def test_packing_wastes_little(spark):
    pieces = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    ids = pieces.agg(F.sum("length")).head()[0]
    windows = pieces.select("sequence_id").distinct().count()
    assert ids / (2048 * windows) > 0.97


def test_token_files_round_trip(spark):
    docs = odd_documents(spark)
    folder = shared_folder(spark, "test-files")
    manifest = token_files.write_token_files(docs, folder, 3)
    rows = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 2, 3, 4, 6, 7, 8, 9, 10]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    at = 0
    for r in rows:
        want = expected_ids("word_bpe_49k.json", texts[r["doc_id"]], 2)
        assert r["start"] == at and r["n_tokens"] == len(want)
        assert np.frombuffer(r["ids"], "<u4").tolist() == want
        at += len(want)
    dictionary = token_files._stored_dictionary(spark, folder)
    one = [x for m in manifest.collect() for x in token_files.read_one(m["path"], 8, dictionary)]
    assert [x.tolist() for x in one] == [expected_ids("word_bpe_49k.json", "a b", 2)]
    nothing = shared_folder(spark, "test-files")
    token_files.write_token_files(empty(spark), nothing, 3)
    assert token_files.read_token_files(spark, nothing).count() == 0


# --- pseudonyms ------------------------------------------------------------------------------


def test_permutation_is_one_to_one():
    for size in (2, 10, 97, 1000):
        assert sorted(pii.permute(k, size, "key", "t") for k in range(size)) == list(range(size))


def test_pseudonyms_keep_format_and_links():
    card, spaced = pii.replace("4799567889864505", "k")[0], pii.replace("4799 5678 8986 4505", "k")[0]
    assert spaced.replace(" ", "") == card != "4799567889864505"
    assert pii.luhn_digit(card[:-1]) == card[-1]
    assert pii.replace("4799567889864506", "k")[0] == "4799567889864506"
    text, numbers, days = pii.replace("on 2024-02-29, mail a.b@x.org or call +1 (722) 555-6978", "k")
    assert (numbers, days) == (2, 1)
    assert datetime.strptime(text[3:13], "%Y-%m-%d")
    assert text[13:22] == ", mail " + text[20:22] and "@x.org" in text and "555-6978" not in text
    assert pii.replace("2024-02-30 and 999.1.1.1", "k")[1:] == (0, 0)
    iban = pii.replace("DE89370400440532013000", "k")[0]
    assert pii._iban_number(iban) % 97 == 1 and iban != "DE89370400440532013000"


def test_pseudonyms_leave_no_phone_or_address(spark):
    rng = np.random.default_rng(4)
    phones = ["+1 (017) 555-7713", "+1 (132) 555-1352", "(017) 155-7713", "117-055-7713", "+11325551352"]
    phones += [f"+1 ({a:03d}) {b:03d}-{c:04d}" for a, b, c in rng.integers(0, [1000, 1000, 10000], (300, 3))]
    addresses = ["248.40.198.62", "240.56.125.154", "127.0.0.1", "0.0.0.0", "255.255.255.255", "224.0.0.1"]
    addresses += [".".join(map(str, x)) for x in rng.integers(0, 256, (300, 4))]
    found = [*phones, *addresses]
    docs = spark.createDataFrame([(k, f"see {x} for it") for k, x in enumerate(found)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.pseudonymize(docs, "k").collect()}
    new = [out[k]["text"][4:-7] for k in range(len(found))]
    assert all(a != b and out[k]["n_numbers"] == 1 for k, (a, b) in enumerate(zip(found, new)))

    def shape(text):
        return "".join("9" if c.isdigit() else c for c in text)

    def in_use(body):
        return body[0] in "23456789" and body[3] in "23456789"

    for a, b in zip(phones, new):
        old, moved = ("".join(c for c in x if c.isdigit())[-10:] for x in (a, b))
        assert shape(a) == shape(b) and a[:2] == b[:2] if a[0] == "+" else shape(a) == shape(b)
        assert in_use(old) == in_use(moved)
    for a, b in zip(addresses, new[len(phones) :]):
        assert max(map(int, b.split("."))) < 256 and len(b.split(".")) == 4
        assert (0 < int(a.split(".")[0]) < 224 and a[:4] != "127.") == (0 < int(b.split(".")[0]) < 224 and b[:4] != "127.")
    assert len(set(new)) == len(set(found))


def test_pseudonyms_of_odd_rows(spark):
    docs = odd_documents(spark)
    out = pii.pseudonymize(docs)
    assert out.count() == 11 and set(docs.columns) < set(out.columns)
    assert out.where("text IS NULL").count() == 1
    assert pii.pseudonymize(empty(spark)).count() == 0


# --- models ----------------------------------------------------------------------------------


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(300, 3)), rng.normal(size=(3, 3))
    p = crf_language.marginals(scores, np.array([300]), moves)
    e, t = np.exp(scores), np.exp(moves)
    forward = [np.ones(3) / 3]
    for x in e:
        step = (forward[-1] @ t) * x
        forward.append(step / step.sum())
    back = np.ones(3)
    for k in range(299, -1, -1):
        q = forward[k + 1] * back
        assert np.allclose(q / q.sum(), p[k])
        back = t @ (e[k] * back)
        back /= back.sum()


def test_language_on_held_out_rows(spark):
    rows = catalog.op8_language(spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    truth = {r["doc_id"]: r["lang"] for r in docs}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_language_of_odd_rows(spark):
    docs = odd_documents(spark)
    found = crf_language.predict(docs, crf_language.fit_on(docs)).collect()
    und = {r["doc_id"] for r in found if r["lang_pred"] == "und"}
    assert len(found) == 11 and und == {3, 4, 6, 10}
    assert all(0 <= r["score"] <= 1 for r in found)
    nothing = crf_language.fit_on(empty(spark))
    assert {r["lang_pred"] for r in crf_language.predict(docs, nothing).collect()} == {"und"}


def test_language_of_long_texts_alone(spark):
    rng = np.random.default_rng(6)
    words = {"xx": "zorp blim quaf dreg vosk".split(), "yy": "une maison petite avec jardin".split()}
    rows = [(k, " ".join(rng.choice(words["xx"], 4000)), "xx") for k in range(6)]
    rows += [(k, " ".join(rng.choice(words["yy"], 60)), "yy") for k in range(6, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = crf_language.fit_on(docs)
    assert model.labels == ["xx", "yy"]
    assert all(r["lang_pred"] == r["lang"] for r in crf_language.predict(docs, model).collect())
    long = docs.where("lang = 'xx'")
    assert crf_language.fit_on(long).labels == ["xx"]
    assert corpus_pipeline.language(spark, long, SF_DIR).count() == 6


def test_language_stage_keeps_unlabelled_texts(spark):
    texts = ["ein Wort", "", None, "123 --", "é", "語", " \n", "1a", "\u00b2 \u0663 \u0301", "\U00010400"]
    docs = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF_DIR).collect()}
    assert kept == {k for k, t in enumerate(texts) if t and any(c.isalpha() for c in t)}


def test_toxicity_on_held_out_rows(spark):
    rows = catalog.op2_toxicity(spark, "/root/testdata/sf0.1").where("held_out").collect()
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    pairs = [(r["score"], truth[r["doc_id"]]) for r in rows if truth.get(r["doc_id"]) is not None]
    bad = np.array([s for s, y in pairs if y])
    good = np.array([s for s, y in pairs if not y])
    assert (bad[:, None] > good[None, :]).mean() > 0.9


def test_toxicity_of_odd_rows(spark):
    docs = odd_documents(spark).withColumn("toxic", F.when(F.col("doc_id") == 1, 1).when(F.col("doc_id") == 8, 0))
    out = toxicity.score(docs, toxicity.fit_on(docs, docs)).collect()
    assert len(out) == 11 and all(0 <= r["score"] <= 1 for r in out)
    nothing = empty(spark).withColumn("toxic", F.lit(None).cast("int"))
    assert toxicity.score(docs, toxicity.fit_on(docs, nothing)).count() == 11
    assert toxicity.score(nothing, toxicity.fit_on(nothing, nothing)).count() == 0


def test_toxicity_of_long_texts(spark):
    rng = np.random.default_rng(9)
    plain, vile = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)], "gruk mulv splor".split()
    rows = []
    for k in range(200):
        words = rng.choice(plain, 5000).tolist()  # 15,000 characters and more
        if k % 4 == 0:
            words[int(rng.integers(0, 4900))] = rng.choice(vile)
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_on(docs.where("doc_id < 150"), docs)
    found = toxicity.score(docs.where("doc_id >= 150"), model).collect()
    assert len(found) == 50 and np.mean([r["predicted"] == r["toxic"] for r in found]) > 0.9
    assert {(r["score"] >= 0.5) == r["predicted"] for r in found} == {True}


def test_toxicity_thresholds_by_brute_force():
    rng = np.random.default_rng(10)
    cells = [(k % 2, int(y), int(s), int(n)) for k, (y, s, n) in enumerate(rng.integers([0, -50, 1], [2, 50, 9], (80, 3)))]
    model = toxicity.fit(["a", "b"], [0, 1], epochs=0)
    toxicity.set_thresholds(model, cells)

    def f1(cut, own):
        hit = sum(n for _, y, s, n in own if y and s / toxicity.GRID >= cut)
        return 2 * hit / (sum(n for _, _, s, n in own if s / toxicity.GRID >= cut) + sum(n for _, y, _, n in own if y))

    for k in range(2):
        own = [c for c in cells if c[0] == k]
        assert f1(model.thresholds[k], own) == max(f1(c[2] / toxicity.GRID, own) for c in own)
    assert f1(model.thresholds[4], cells) == max(f1(c[2] / toxicity.GRID, cells) for c in cells)


def test_language_model(spark):
    rows = catalog.op7_interpolation(spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    from collections import Counter

    counts = Counter()
    fold = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}  # A-Z alone
    tokens = {k: [*t.translate(fold).split(), None] for k, t in docs.items()}
    for k, t in tokens.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        t = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), n)
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        assert abs(base - r["base_score"]) < 1e-6 * abs(base)
        assert np.isfinite(r["score"]) and r["score"] <= 0
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_weights_of_several_chunks(spark):
    """Weights come from all training tokens: scores against counts and cells by brute force."""
    from collections import Counter

    import pandas as pd

    rng = np.random.default_rng(8)
    long = [f"{k}".zfill(4) * 75 for k in range(200)]  # words of 300 bytes: few fill a chunk
    rows = []
    for k in range(7):
        # The first texts repeat a phrase, the others are at random.
        text = long[:5] * 2500 if k < 2 else [long[j] for j in rng.integers(0, 200, 12_500)]
        rows.append((k, " ".join(text)))
    assert len(rows[0][1]) * 2 > interpolation.CHUNK_BYTES
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: r for r in interpolation.score(docs, F.col("doc_id") != 6).collect()}
    words, pairs = Counter(), Counter()
    texts = {k: [*text.split(" "), "\n"] for k, text in rows}
    for k in range(6):
        words.update(texts[k])
        pairs.update(zip(["\n", *texts[k]], texts[k]))
    n, v = sum(words.values()), len(words)
    assert found[0]["train_tokens"] == n == 6 * 12_501

    def cell(a, b, own):
        context = words[a] - own
        ratios = (pairs[a, b] - own) / max(context, 1), (words[b] - own) / (n - 1)
        return (int(interpolation.frequency_bucket(np.array([context]))[0]), *(int(interpolation._bin(np.array([x]))[0]) for x in ratios))

    cells = Counter()
    for (a, b), count in pairs.items():
        cells[cell(a, b, 1)] += count
    table = pd.DataFrame([(*c, k) for c, k in cells.items()], columns=["bucket", "pair", "word", "n"])
    weights = interpolation.learn_weights(table, v)
    for k, text in texts.items():
        total = 0.0
        for (a, b), count in Counter(zip(["\n", *text], text)).items():
            w = weights[interpolation.frequency_bucket(np.array([words[a]]))[0]]
            total += count * np.log10(w[0] * pairs[a, b] / max(words[a], 1) + w[1] * words[b] / n + w[2] / (v + 1))
        assert found[k]["score"] == pytest.approx(total, rel=1e-9)


def test_language_model_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = interpolation.score(docs, F.lit(True)).collect()
    assert len(rows) == 11 and all(r["n_tokens"] == r["n_known"] for r in rows)
    assert interpolation.score(docs, F.lit(False)).where("train_tokens = 0").count() == 11


# --- vectors ---------------------------------------------------------------------------------


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.1], 2),
        (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1),
        (None, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0], None),
    ]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_near_vectors_of_odd_rows(spark):
    rows = cap_filters.near_vectors(odd_vectors(spark)).collect()
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows}
    assert len(rows) == 13
    assert found[1] == (4, 1, True) and found[3] == (4, 1, False) and found[None] == (4, 1, False)
    for k in (4, 5, 6, 7, 8, 9, 10, 11):
        assert found[k] == (0, k, True)


def test_near_vectors_finds_all_of_a_group(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    x = np.concatenate([centre + 0.05 * rng.normal(size=(700, 16)), rng.normal(size=(200, 16))])
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    found = cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    links = near.sum(1) - 1
    assert {r["vec_id"]: r["n_links"] for r in found.collect()} == dict(enumerate(links.tolist()))


def test_nearest_recall(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = catalog.op3_nearest(spark, sf_dir).collect()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in table])
    x = np.array([r["embedding"] for r in table], np.float64)
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        hits += len(set(best) & set(found[ids[k]]))
        total += 20
    assert hits / total >= 0.9


def test_nearest_of_odd_rows(spark):
    rows = permutation_index.nearest(odd_vectors(spark), F.col("vec_id") == 1, 3).collect()
    found = [(r["rank"], r["vec_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"])]
    assert found == [(1, 2, 2.0), (2, 3, 1.0), (3, 4, 1.0)]


# --- pipeline --------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = odd_documents(spark).select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
    assert {r["doc_id"] for r in docs.collect()} <= {None, 1, 7, 8}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() > 0


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def words_of(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))


def test_near_duplicate_stage_by_brute_force(spark):
    """Different texts under one id, rows without ids, rows alike in all but other columns."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(12):
        text = words_of(rng, 30)
        rows += [(k, text, "en", "a", 1), (int(rng.integers(0, 40)), text + " tail", "en", "b", 2)]
        rows += [(k, words_of(rng, 9), "de", "c", 3)] * 2 + [(k, words_of(rng, 3), "de", None, 3)]
        rows += [(None, words_of(rng, 20), "fr", "d", 4), (None, text + " end", None, "d", 4)]
    rows.append((0, rows[0][1], "zz", "zz", 9))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = stage("near_duplicates")(spark, docs, SF_DIR).collect()
    label = brute_components([((r[0] if r[0] is not None else 10**9, k), r[1]) for k, r in enumerate(rows)])
    groups = {}
    for (key, k), (_, first) in label.items():
        groups.setdefault(first, []).append(rows[k])
    assert len(found) == len(groups)
    kept = {(r["doc_id"], r["text"]): tuple(r) for r in found}
    for members in groups.values():
        here = [m for m in members if (m[0], m[1]) in kept]
        assert len({(m[0], m[1]) for m in here}) == 1
        ids = [m[0] for m in members if m[0] is not None]
        assert here[0][0] == (min(ids) if ids else None)
        assert kept[here[0][:2]] == min(here, key=lambda m: (m[2] is not None, m[2] or "", m[3] is not None, m[3] or ""))


def test_mix_stage_by_words(spark):
    rng = np.random.default_rng(13)
    rows = [(k // 2, words_of(rng, int(rng.integers(1, 40))), "en", "abc"[k % 3], k) for k in range(120)]
    rows += [rows[0], (None, "one two", "en", "a", 1), (7, None, "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = stage("mix")(spark, docs, SF_DIR).collect()
    texts = {(r[0], r[1]) for r in rows}
    sizes, goal = {}, {}
    for r in {(r[0], r[1], r[3]) for r in rows}:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    total, level = sum(sizes.values()), dict(zip("abc", (5, 2, 1)))
    goal = {s: min(3 * sizes[s], total * w / 8) for s, w in level.items()}
    assert goal["a"] < 3 * sizes["a"] and goal["b"] < 3 * sizes["b"]
    for source in "abc":
        mine = [r["text"] or "" for r in taken if r["source"] == source]
        assert abs(sum(len(t.split()) for t in mine) - goal[source]) <= 1
        cut = [t for r, t in ((r, r["text"] or "") for r in taken if r["source"] == source) if (r["doc_id"], t) not in texts]
        assert len(cut) <= 1 and all(any((t or "").startswith(c) for _, t in texts) for c in cut)


def test_other_stages_row_by_row(spark):
    docs = odd_documents(spark).select(*corpus_pipeline.COLUMNS)
    model = crf_language.fit_on(docs)
    told = [r for r in crf_language.predict(docs, model).collect() if r["lang_pred"] != "und"]
    kept = stage("language")(spark, docs, SF_DIR).collect()
    assert sorted(map(str, kept)) == sorted(str(r.__class__(**{c: r[c] for c in docs.columns})) for r in told)
    private = {(r["doc_id"], r["n_chars"]): r["text"] for r in pii.pseudonymize(docs).collect()}
    clean = stage("private_data")(spark, docs, SF_DIR).collect()
    assert len(clean) == 11 and all(private[r["doc_id"], r["n_chars"]] == r["text"] for r in clean)
    packed = stage("pack")(spark, docs, SF_DIR).collect()
    ids = b"".join(p["ids"] for p in sorted((p for p in packed if p["doc_id"] == 7), key=lambda p: p["start"]))
    text = next(r["text"] for r in docs.collect() if r["doc_id"] == 7)
    assert np.frombuffer(ids, "<u4").tolist() == expected_ids("byte_bpe_50k.json", text, 1)


def test_special_strings_are_the_librarys(spark):
    texts = ["say <|endoftext|> now", "a<|endoftext|>b.<|startoftext|>", " <|endoftext|>", "<|endoftext|>\n\n<|endoftext|>  x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for piece in packing.pack(docs).collect():
        assert np.frombuffer(piece["ids"], "<u4").tolist() == expected_ids("byte_bpe_50k.json", texts[piece["doc_id"]], 1)
    folder = shared_folder(spark, "test-special")
    token_files.write_token_files(docs, folder, 1)
    for row in token_files.read_token_files(spark, folder).collect():
        assert np.frombuffer(row["ids"], "<u4").tolist() == expected_ids("word_bpe_49k.json", texts[row["doc_id"]], 2)


def test_pipeline_runs(spark):
    pieces = corpus_pipeline.run(spark, SF_DIR)
    assert pieces.count() > 0
