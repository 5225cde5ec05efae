"""The operators as queries over the given tables, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrika.llm import (
    cap_filters,
    crf_language,
    edit_tiles,
    interpolation,
    max_sketches,
    merge_replay,
    mixing,
    ngram_join,
    packing,
    permutation_index,
    pii,
    token_files,
    toxicity,
)
from rubrika.llm.common import fold, shuffle_partitions, table
from rubrika.session import shared_folder


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit_on(docs.where(~held_out), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op7_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) != 2)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = crf_language.fit_on(docs.where(~held_out))
    found = crf_language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "switches")


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    shards = 2 * shuffle_partitions(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, shards)
    docs = token_files.read_token_files(spark, folder)
    return docs.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op11_edit_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_tiles.variants(edit_tiles.count_words(table(spark, sf_dir, "documents")))


def op12_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = merge_replay.encode(table(spark, sf_dir, "documents"))
    digests = merge_replay.ids_digest(merge_replay.decode(encoded))
    return digests.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op13_max_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketches.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix, op2_toxicity, op3_nearest, op4_ngram_join, op5_pseudonyms, op6_packing, op7_interpolation,
        op8_language, op9_near_vectors, op10_token_files, op11_edit_tiles, op12_merge_replay,
        op13_max_sketches,
    )
}

ORACLES: dict[str, str] = {}

ORACLES["op1_mix"] = r"""
WITH RECURSIVE raw AS (
    SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), m AS (
    SELECT doc_id, source,
        length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS size,
        greatest(0.25, coalesce(strlen(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g'))
            / nullif(strlen(text), 0)::DOUBLE, 0)) AS quality,
        (('0x' || substr(md5(coalesce(doc_id, 0)::VARCHAR || ':mix-1'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
    FROM raw
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
    FROM m GROUP BY source
), f AS (
    SELECT *, 3.0 * source_size AS cap, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
        coalesce(sum(3.0 * source_size) OVER w, 0) AS cut, coalesce(sum(weight) OVER w, 0) AS gone
    FROM s WINDOW w AS (ORDER BY 3.0 * source_size / weight, source_size, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
    SELECT *, (total - cut) / (weights - gone) AS level FROM f
), t AS (
    SELECT source, source_size, least(cap, weight * coalesce(
        (SELECT arg_min(level, cap / weight) FROM l WHERE cap / weight >= level), 1e300)) AS target FROM l
), e AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), g AS (
    SELECT *, round(target - epochs * source_size)::BIGINT AS rest FROM e
), d AS (
    SELECT m.doc_id, m.size, g.source_size, g.target, g.epochs, g.rest,
        coalesce(sum(m.size) OVER (PARTITION BY m.source ORDER BY -ln(u) / quality, m.doc_id, m.size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM m JOIN g ON m.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
    (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM d
"""

ORACLES["op4_ngram_join"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), sets AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g
    FROM w
), n AS (
    SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), rare AS (
    SELECT g FROM sets GROUP BY g HAVING count(*) > 1
), shared AS (
    SELECT doc_id, g FROM sets SEMI JOIN rare USING (g)
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
    FROM shared a JOIN shared b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * k >= 75 * (x.n + y.n - k)
), edges AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT a AS doc_id, a AS node FROM edges
    UNION
    SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.node
), c AS (
    SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

ORACLES["op9_near_vectors"] = r"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
    SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL
        AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE len(a.e) = len(b.e)
        AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= 0.98
), reach AS (
    SELECT a AS vec_id, a AS node FROM links
    UNION
    SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.node
), c AS (
    SELECT vec_id, min(node) AS component_id FROM reach GROUP BY vec_id
), k AS (
    SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, v.vec_id) AS component_id,
    v.vec_id = coalesce(component_id, v.vec_id) AS kept
FROM v LEFT JOIN c USING (vec_id) LEFT JOIN k USING (vec_id)
"""

# The checksum of a text's bytes by a table of 256 entries, itself computed here.
ORACLES["op11_edit_tiles"] = r"""
WITH RECURSIVE tab AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
            lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) AS c
        FROM (SELECT unnest(range(0, 256))::BIGINT AS i))
), runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
    FROM documents
), r AS (
    SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x
    FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run
), h AS (
    SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2),
        lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
    FROM r, tab
), d AS (
    SELECT k, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
        ELSE run END AS word
    FROM h
), w AS (
    SELECT word, sum(k)::BIGINT AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), cut AS (
    SELECT word, n, i, left(word, i) AS a, substr(word, i + 2) AS b
    FROM (SELECT word, n, unnest(range(0, length(word)))::INT AS i FROM w)
), shorter AS (
    SELECT DISTINCT c.word AS l, c.n AS l_n, w.word AS s, w.n AS s_n FROM cut c JOIN w ON c.a || c.b = w.word
), near AS (
    SELECT l AS word, s AS near, s_n AS near_n FROM shorter
    UNION ALL SELECT s, l, l_n FROM shorter
    UNION ALL SELECT x.word, y.word, y.n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
), best AS (
    SELECT word, count(*) AS n_near, min({'less': -near_n, 'form': near}) AS best FROM near GROUP BY word
), f AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
        CASE WHEN -best.less >= 5 * w.n THEN best.form END AS form, CASE WHEN -best.less >= 5 * w.n THEN -best.less END AS form_n
    FROM w LEFT JOIN best USING (word)
), walk AS (
    SELECT word, word AS spot, 0 AS steps FROM f
    UNION ALL
    SELECT walk.word, f.form, steps + 1 FROM walk JOIN f ON f.word = walk.spot WHERE f.form IS NOT NULL
), ends AS (
    SELECT word, arg_max(spot, steps) AS root FROM walk GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""

ORACLES["op13_max_sketches"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM documents
), o AS (
    SELECT r, doc_id, len(t) AS n, t FROM d WHERE len(t) > 0
), s AS (
    SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM o
), f AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM o) GROUP BY r, term
), w AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM f, s GROUP BY term, docs
), i AS (
    SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), k AS (
    SELECT q, item_id, term, count(*) AS times FROM i GROUP BY q, item_id, term
), p AS (
    SELECT q, item_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
    FROM k JOIN w USING (term) JOIN f USING (term) JOIN o USING (r), s GROUP BY q, item_id, r
), b AS (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank
    FROM p JOIN o USING (r) WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM b WHERE rank <= 20
"""
