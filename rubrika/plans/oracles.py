"""The queries of ``rubrika.plans.catalog`` as DuckDB SQL, written on their own."""

from __future__ import annotations

import unicodedata

# Fixed values, written here again so that a change in the package shows: category names by class id,
# and the size of the vocabulary.
LABELS = ("World", "Sports", "Business", "Science/Technology")
VOCABULARY_SIZE = 30522


def _base(letter: str) -> str:
    """The letter under all accents, by single steps of canonical decomposition."""
    while True:
        parts = unicodedata.decomposition(letter).split()
        if not parts or parts[0].startswith("<"):
            return letter
        letter = chr(int(parts[0], 16))


# Lower-case letters of the Latin blocks that have an accent; marks without a letter are deleted.
_LATIN = [chr(c) for first, last in ((0x00C0, 0x024F), (0x1E00, 0x1EFF)) for c in range(first, last + 1)]
_CHANGED = [c for c in _LATIN if not c.isupper() and c.lower() == c and _base(c) != c]
ACCENTED = "".join(_CHANGED) + "".join(map(chr, range(0x0300, 0x0370)))
PLAIN = "".join(map(_base, _CHANGED))

# Unicode whitespace spelled out, as \s is ASCII in this dialect.
SPACES = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE = f"[{SPACES}]"
NOT_SPACE = f"[^{SPACES}]"
TAG = r"<[^\n]*?>"
URL = rf"http{NOT_SPACE}+|www\.{NOT_SPACE}+"
TOKEN = r"[\p{L}\p{M}\p{N}]+|[\p{P}\p{S}]"

CLASSES = range(len(LABELS))


def _clean(text: str) -> str:
    return rf"""
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        coalesce({text}, ''),
        '{TAG}', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '{URL}', ' ', 'g'), '{SPACE}+', ' ', 'g'), ' ')
    """


def _tokens(text: str) -> str:
    return f"regexp_extract_all(translate(lower({_clean(text)}), '{ACCENTED}', '{PLAIN}'), '{TOKEN}')"


def _name(class_id: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(LABELS))
    return f"CASE {class_id} {whens} ELSE 'Unknown' END"


def _each(pattern: str, joiner: str = ", ") -> str:
    return joiner.join(pattern.format(c=c) for c in CLASSES)


LANG_CLASS = "CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 END"
SPLIT = "CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END"
EVENT_LABEL = """
    CASE event_type WHEN 'view' THEN 'World' WHEN 'click' THEN 'Sports'
    WHEN 'purchase' THEN 'Business' WHEN 'signup' THEN 'Science/Technology' ELSE 'Unknown' END
"""
EVENT_CONFIDENCE = "CAST(round(CAST(value / (value + 100.0) AS DECIMAL(18,10)), 4) AS DOUBLE)"
TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
FIRST_LINE = "split_part(text, chr(10), 1)"
SHARE = "CAST(n_chars AS DOUBLE) / (n_chars + 1000.0)"
DOC_TIME = "TIMESTAMP '2024-01-01' + to_hours(doc_id % 720)"

LOG = f"""
    log AS (
        SELECT event_id AS id, props AS input_text, {EVENT_LABEL} AS predicted_label,
               {EVENT_CONFIDENCE} AS confidence, ts AS created_at
        FROM events
    )
"""

TOKENS = f"""
    docs AS (SELECT doc_id, text, {LANG_CLASS} AS label, {SPLIT} AS split FROM documents),
    listed AS (SELECT doc_id, label, split, {_tokens("text")} AS tokens FROM docs),
    tok AS (SELECT doc_id, label, split, unnest(tokens) AS token FROM listed)
"""

VOCABULARY = f"""
    {TOKENS},
    counted AS (SELECT token, count(*) AS n FROM tok GROUP BY token),
    best AS (SELECT * FROM counted ORDER BY n DESC, token LIMIT {VOCABULARY_SIZE - 4}),
    vocabulary AS (
        SELECT token, CAST(3 + row_number() OVER (ORDER BY n DESC, token) AS INTEGER) AS token_id, n
        FROM best
    )
"""

ENCODED = f"""
    {VOCABULARY},
    placed AS (
        SELECT doc_id, generate_subscripts(tokens, 1) AS pos, unnest(tokens) AS token FROM listed
    ),
    short AS (SELECT * FROM placed WHERE pos <= 126),
    lengths AS (
        SELECT doc_id, least(len(tokens), 126) AS n FROM listed
    ),
    real_ids AS (
        SELECT doc_id, CAST(0 AS BIGINT) AS pos, 2 AS input_id FROM lengths
        UNION ALL
        SELECT s.doc_id, s.pos, coalesce(v.token_id, 1) FROM short s LEFT JOIN vocabulary v USING (token)
        UNION ALL
        SELECT doc_id, n + 1, 3 FROM lengths
    )
"""



def _bayes(vocabulary_size: int | None = None) -> str:
    best = f"ORDER BY n DESC, token LIMIT {vocabulary_size}" if vocabulary_size else ""
    return f"""
    {TOKENS},
    counted AS (
        SELECT token, count(*) AS n, {_each("count(*) FILTER (label = {c}) AS n{c}")}
        FROM tok WHERE split = 'train' GROUP BY token
        {best}
    ),
    totals AS (SELECT count(*) AS v, {_each("sum(n{c}) AS t{c}")} FROM counted),
    sizes AS (
        SELECT count(*) AS d, {_each("count(*) FILTER (label = {c}) AS d{c}")}
        FROM docs WHERE split = 'train'
    ),
    weights AS (
        SELECT token, {_each("n{c}")}, {_each("ln((n{c} + 1.0) / (t{c} + v)) AS w{c}")}
        FROM counted, totals
    )
    """


def _scored(vocabulary_size: int | None = None, tokens: str = "tokens") -> str:
    return f"""
    {_bayes(vocabulary_size)},
    used AS (SELECT doc_id, unnest({tokens}) AS token FROM listed),
    sums AS (
        SELECT doc_id, {_each("sum(w{c}) AS s{c}")} FROM used JOIN weights USING (token)
        GROUP BY doc_id
    ),
    raw AS (
        SELECT doc_id, label, split,
               {_each("coalesce(s{c}, 0) + ln((d{c} + 1.0) / (d + 4.0)) AS r{c}")}
        FROM docs LEFT JOIN sums USING (doc_id), sizes
        WHERE regexp_matches(text, '{NOT_SPACE}')
    ),
    shifted AS (
        SELECT doc_id, label, split, {_each("exp(r{c} - greatest(r0, r1, r2, r3)) AS e{c}")} FROM raw
    ),
    shares AS (
        SELECT doc_id, label, split, {_each("e{c} / (e0 + e1 + e2 + e3) AS p{c}")} FROM shifted
    ),
    scored AS (
        SELECT *, greatest(p0, p1, p2, p3) AS top,
               CASE greatest(p0, p1, p2, p3) WHEN p0 THEN 0 WHEN p1 THEN 1 WHEN p2 THEN 2 ELSE 3 END
                   AS predicted_id
        FROM shares
    ),
    predicted AS (
        SELECT doc_id, label, split, predicted_id, {_name("predicted_id")} AS predicted_label,
               round(top, 4) AS confidence
        FROM scored
    ),
    per_class AS (
        {_each("SELECT doc_id, {c} AS class_id, round(p{c}, 4) AS score FROM shares", " UNION ALL ")}
    )
    """


BAYES = _bayes()
SCORED = _scored()

RANKED = f"""
    WITH {SCORED}
    SELECT doc_id,
           CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, class_id) - 1 AS INTEGER)
               AS place,
           {_name("class_id")} AS label, score
    FROM per_class
"""

PREDICTED = f"""
    WITH {SCORED}
    SELECT doc_id, predicted_id, predicted_label, confidence FROM predicted
"""

VECTORS = f"""
    WITH parts AS (
        SELECT vec_id, label, generate_subscripts(embedding, 1) AS i,
               CAST(unnest(embedding) AS DOUBLE) AS x
        FROM embeddings
    ),
    means AS (SELECT label AS class_id, i, avg(x) AS m FROM parts GROUP BY label, i),
    logits AS (
        SELECT vec_id, class_id, 50.0 * sum(x * m) AS z FROM parts JOIN means USING (i)
        GROUP BY vec_id, class_id
    ),
    weights AS (
        SELECT vec_id, class_id, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM logits
    ),
    shares AS (
        SELECT vec_id, class_id, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM weights
    ),
    best AS (
        SELECT vec_id, class_id, p,
               row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class_id) AS place
        FROM shares
    )
    SELECT vec_id, class_id AS predicted_id, {_name("class_id")} AS predicted_label,
           round(p, 4) AS confidence
    FROM best WHERE place = 1
"""

RATE, EPOCHS = 100.0, 3


def _epoch(k: int) -> str:
    """Weights after one step over the training documents, and the shares they give all documents."""
    before = f"LEFT JOIN w{k - 1} AS old USING (token)" if k > 1 else ""
    old = "coalesce(any_value(old.v{c}), 0)" if k > 1 else "0"
    step = old + f" - {RATE} * sum(x * (p.q{{c}} - (p.label = {{c}})::INT)) / any_value(n_train) AS v{{c}}"
    top = "greatest(" + _each("z{c}") + ")"
    whole = "(" + _each(f"exp(z{{c}} - {top})", " + ") + ")"
    return f"""
    w{k} AS (
        SELECT token, {_each(step)}
        FROM x JOIN p{k - 1} AS p USING (doc_id) {before}, sizes WHERE p.split = 'train' GROUP BY token
    ),
    z{k} AS (
        SELECT doc_id, any_value(d.label) AS label, any_value(d.split) AS split,
               {_each("coalesce(sum(x * v{c}), 0) AS z{c}")}
        FROM docs AS d LEFT JOIN x USING (doc_id) LEFT JOIN w{k} USING (token) GROUP BY doc_id
    ),
    p{k} AS (SELECT doc_id, label, split, {_each(f"exp(z{{c}} - {top}) / {whole} AS q{{c}}")} FROM z{k})
    """


Q = "[" + ", ".join(f"q{c}" for c in CLASSES) + "]"
LOSS = f"avg(-ln(greatest({Q}[label + 1], 1e-15)))"
BEST_CLASS = f"list_position({Q}, list_max({Q})) - 1"
TRAINED = f"""
    {TOKENS},
    sizes AS (SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test FROM docs),
    top AS (
        SELECT token FROM tok WHERE split = 'train' GROUP BY token ORDER BY count(*) DESC, token LIMIT {VOCABULARY_SIZE}
    ),
    x AS (
        SELECT doc_id, token, count(*) / any_value(len(tokens)) AS x
        FROM tok JOIN listed USING (doc_id) SEMI JOIN top USING (token) GROUP BY doc_id, token
    ),
    p0 AS (SELECT doc_id, label, split, {_each("0.25 AS q{c}")} FROM docs),
    {", ".join(_epoch(k) for k in range(1, EPOCHS + 1))},
    measured AS (
        {" UNION ALL ".join(
            f"SELECT {k} AS epoch, (SELECT {LOSS} FROM p{k - 1} WHERE split = 'train') AS train_loss, {LOSS} AS loss, "
            f"avg(({BEST_CLASS} = label)::INT) AS accuracy FROM p{k} WHERE split = 'test'"
            for k in range(1, EPOCHS + 1)
        )}
        UNION ALL SELECT 0, NULL, {LOSS}, avg(({BEST_CLASS} = label)::INT) FROM p0 WHERE split = 'test'
    )
"""

EVENT_ROWS = f"""
    rows AS (
        SELECT event_id AS id, props AS input_text,
               CASE WHEN event_type <> 'error' THEN {EVENT_LABEL} END AS predicted_label,
               value / 100.0 AS confidence, ts AS created_at
        FROM events
    ),
    checked AS (
        SELECT *, CASE WHEN predicted_label IS NULL THEN 'predicted_label is null'
                       WHEN confidence IS NULL THEN 'confidence is null'
                       WHEN NOT (confidence >= 0 AND confidence <= 1)
                           THEN 'confidence is outside 0..1' END AS reason
        FROM rows
    )
"""

STATS = """
    SELECT predicted_label, count(*) AS total_predictions,
           CAST(round(avg(CAST(confidence AS DECIMAL(20,15))), 4) AS DOUBLE) AS avg_confidence,
           strftime(max(created_at), '%Y-%m-%d %H:%M:%S.%f') AS last_seen
    FROM {0} GROUP BY predicted_label
"""

VOLUME = """
    SELECT strftime(created_at, '%Y-%m-%d') AS prediction_date, count(*) AS total,
           count(DISTINCT predicted_label) AS unique_categories
    FROM log GROUP BY ALL
"""


def _recent(limit: int) -> str:
    return f"""
    WITH {LOG}
    SELECT id, input_text, predicted_label, confidence, {TIME.format("created_at")} AS created_at
    FROM log ORDER BY log.created_at DESC, id DESC LIMIT {limit}
    """


HISTORY = f"""
    history AS (
        SELECT doc_id AS id, {DOC_TIME} AS created_at, text, {_name(LANG_CLASS)} AS predicted_label,
               CAST(round(CAST({SHARE} AS DECIMAL(18,10)), 4) AS DOUBLE) AS confidence
        FROM documents
    ),
    lines AS (
        SELECT id, created_at,
               '[' || strftime(created_at, '%Y-%m-%d %H:%M') || '] ' || predicted_label
                   || ' (' || printf('%.1f', confidence * 100) || '%)' AS heading,
               CASE WHEN length(text) > 300 THEN text[1:300] || '...' ELSE text END AS preview
        FROM history
    )
"""

ORACLES = {
    "categorize_and_log": f"""
        WITH {SCORED}
        SELECT predicted_label, count(*) AS total_predictions,
               CAST(round(avg(CAST(confidence AS DECIMAL(20,15))), 4) AS DOUBLE) AS avg_confidence
        FROM predicted GROUP BY predicted_label
    """,
    "corpus_split": f"SELECT doc_id, {LANG_CLASS} AS label, {SPLIT} AS split FROM documents",
    "corpus_formats": f"""
        SELECT doc_id, text, {LANG_CLASS} AS label, unnest(['json', 'orc']) AS source FROM documents
    """,
    "corpus_malformed": f"""
        SELECT CASE WHEN doc_id % 50 NOT IN (7, 11) THEN doc_id END AS doc_id,
               CASE WHEN doc_id % 50 NOT IN (7, 11, 13) THEN md5(text) END AS text_md5,
               CASE doc_id % 50 WHEN 7 THEN NULL WHEN 11 THEN NULL WHEN 13 THEN 1 ELSE {LANG_CLASS} END AS label,
               CASE doc_id % 50 WHEN 7 THEN 'record does not fit the schema'
                   WHEN 11 THEN 'record does not fit the schema' WHEN 13 THEN 'text is missing' END AS reason,
               CASE doc_id % 50 WHEN 7 THEN '{{"doc_id": ' || doc_id || ', "text": "cut'
                   WHEN 11 THEN '{{"doc_id": ' || doc_id || ', "text": "x", "label": "none"}}' END AS raw
        FROM documents
    """,
    "subset_head": f"""
        WITH docs AS (SELECT {SPLIT} AS split, doc_id, {LANG_CLASS} AS label FROM documents),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS place FROM docs
        )
        SELECT split, doc_id, label FROM placed
        WHERE place <= CASE split WHEN 'train' THEN 500 ELSE 100 END
    """,
    "clean_documents": f"SELECT doc_id, {_clean('text')} AS clean FROM documents",
    "clean_pages": f"SELECT page_id, {_clean('html')} AS clean FROM pages",
    "clean_urls": f"""
        SELECT page_id, {_clean("'see ' || url || ' for page ' || page_id")} AS clean FROM pages
    """,
    "combine_title_body": f"""
        SELECT doc_id,
               {_clean(FIRST_LINE)} || ' [SEP] ' || {_clean(f"substr(text, length({FIRST_LINE}) + 2)")}
                   AS combined_text,
               {LANG_CLASS} AS label
        FROM documents
    """,
    "reject_blank": f"""
        WITH split_up AS (SELECT page_id, regexp_split_to_array(html, '{TAG}') AS parts FROM pages),
        parts AS (
            SELECT page_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS part,
                   unnest(parts) AS text
            FROM split_up
        )
        SELECT page_id, part, text,
               CASE WHEN NOT regexp_matches(text, '{NOT_SPACE}') THEN 'text is blank' END AS reason
        FROM parts
    """,
    "token_counts": f"WITH {TOKENS} SELECT token, count(*) AS n FROM tok GROUP BY token",
    "vocab_build": f"WITH {VOCABULARY} SELECT token, token_id, n FROM vocabulary",
    "encode_fixed_length": f"""
        WITH {ENCODED},
        slots AS (
            SELECT doc_id, unnest(range(0, 128)) AS pos FROM lengths
        )
        SELECT s.doc_id, CAST(s.pos AS INTEGER) AS pos, coalesce(r.input_id, 0) AS input_id,
               CASE WHEN r.input_id IS NULL THEN 0 ELSE 1 END AS attention
        FROM slots s LEFT JOIN real_ids r ON s.doc_id = r.doc_id AND s.pos = r.pos
    """,
    "encode_labelled": f"""
        WITH {ENCODED}
        SELECT doc_id, label, CAST(pos AS INTEGER) AS pos, input_id FROM real_ids JOIN docs USING (doc_id)
    """,
    "encode_unpadded": f"""
        WITH {ENCODED}
        SELECT doc_id, CAST(pos AS INTEGER) AS pos, input_id, 1 AS attention FROM real_ids
    """,
    "label_lookup": f"SELECT vec_id, label, {_name('label')} AS label_name FROM embeddings",
    "label_inverse": f"""
        SELECT event_id, {EVENT_LABEL} AS label_name,
               CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2
               WHEN 'signup' THEN 3 ELSE -1 END AS label_id
        FROM events
    """,
    "softmax_scores": """
        WITH parts AS (
            SELECT vec_id, generate_subscripts(embedding, 1) AS i,
                   CAST(unnest(embedding) AS DOUBLE) AS z
            FROM embeddings
        ),
        weights AS (
            SELECT vec_id, i, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM parts
        )
        SELECT vec_id, CAST(i - 1 AS INTEGER) AS class_id,
               round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS share
        FROM weights
    """,
    "vector_score": VECTORS,
    "vector_score_columns": VECTORS,
    "nb_model": f"""
        WITH {BAYES}
        {_each(
            "SELECT token, {c} AS label, n{c} AS n, round(w{c}, 6) AS log_prob FROM weights",
            " UNION ALL ",
        )}
    """,
    "predict_nb": PREDICTED,
    "predict_encoded": f"""
        WITH {_scored(VOCABULARY_SIZE - 4, "tokens[1:126]")}
        SELECT doc_id, predicted_id, predicted_label, confidence FROM predicted
    """,
    "scores_ranked": RANKED,
    "scores_json_roundtrip": RANKED,
    "eval_accuracy": f"""
        WITH {SCORED}
        SELECT split, count(*) AS n,
               round(avg(CASE WHEN predicted_id = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
        FROM scored GROUP BY split
    """,
    "eval_log_loss": f"""
        WITH {SCORED}
        SELECT split, count(*) AS n,
               round(avg(-ln(greatest(
                   CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END, 1e-15))), 4)
                   AS log_loss
        FROM scored GROUP BY split
    """,
    "model_roundtrip": PREDICTED,
    "log_prepare": f"""
        SELECT doc_id AS id, text[1:4000] AS input_text, {SHARE} AS confidence,
               coalesce(nullif(split_part(text, chr(10), 2), ''), 'v1.0') AS model_version,
               {TIME.format(DOC_TIME)} AS created_at
        FROM documents
    """,
    "log_validate": f"""
        WITH {EVENT_ROWS}
        SELECT id, predicted_label, confidence, reason,
               CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status
        FROM checked
    """,
    "log_validate_articles": f"""
        WITH rows AS (
            SELECT doc_id AS id, {FIRST_LINE} AS predicted_label, {SHARE} AS confidence,
                   split_part(text, chr(10), 2) AS model_version
            FROM documents
        ),
        checked AS (
            SELECT *, CASE WHEN length(predicted_label) > 64
                               THEN 'predicted_label is longer than 64'
                           WHEN length(model_version) > 128
                               THEN 'model_version is longer than 128' END AS reason
            FROM rows
        )
        SELECT id, predicted_label, confidence, reason,
               CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status
        FROM checked
    """,
    "log_append": f"""
        WITH {EVENT_ROWS}
        SELECT CAST(1 AS BIGINT) AS batch_id, id, input_text, predicted_label, confidence,
               'v1.0' AS model_version, {TIME.format("created_at")} AS created_at,
               strftime(created_at, '%Y-%m-%d') AS prediction_date
        FROM checked WHERE reason IS NULL
    """,
    "log_rejected": f"""
        WITH {EVENT_ROWS}
        SELECT CAST(1 AS BIGINT) AS batch_id, id, confidence, reason
        FROM checked WHERE reason IS NOT NULL
    """,
    "train_epochs": f"""
        WITH {TRAINED}
        SELECT CAST(epoch AS INTEGER) AS epoch, n_train, n_test, round(train_loss, 6) AS train_loss,
               round(loss, 6) AS loss, round(accuracy, 6) AS accuracy,
               row_number() OVER (ORDER BY accuracy DESC, epoch) = 1 AS is_best
        FROM measured, sizes
    """,
    "predict_epochs": f"""
        WITH {TRAINED},
        every AS ({" UNION ALL ".join(f"SELECT {k} AS epoch, * FROM p{k}" for k in range(EPOCHS + 1))}),
        best AS (SELECT epoch FROM measured ORDER BY accuracy DESC, epoch LIMIT 1)
        SELECT doc_id, CAST({BEST_CLASS} AS INTEGER) AS predicted_id, {_name(BEST_CLASS)} AS predicted_label,
               round(list_max({Q}), 4) AS confidence
        FROM every JOIN best USING (epoch) JOIN documents USING (doc_id) WHERE regexp_matches(text, '{NOT_SPACE}')
    """,
    "log_repeated_ids": f"""
        WITH {EVENT_ROWS},
        shared AS (
            SELECT id - id % 3 AS id, CASE WHEN id % 4 < 2 THEN 1 ELSE 2 END AS batch_id, reason FROM checked
        ),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY batch_id, id, reason IS NULL) AS place,
                   count(*) FILTER (batch_id = 1 AND reason IS NULL) OVER (PARTITION BY id) > 0 AS in_first
            FROM shared
        )
        SELECT CAST(batch_id AS BIGINT) AS batch_id, id,
               CASE WHEN reason IS NOT NULL THEN reason
                    WHEN batch_id = 2 AND in_first THEN 'id is in another batch of the source'
                    WHEN place > 1 THEN 'id is repeated in the batch' END AS reason
        FROM placed
    """,
    "log_compacted": f"""
        WITH {LOG}
        SELECT id % 4 AS batch_id, id, predicted_label, confidence,
               strftime(created_at, '%Y-%m-%d') AS prediction_date
        FROM log
    """,
    "category_stats": f"WITH {LOG} {STATS.format('log')}",
    "daily_volume": f"WITH {LOG} {VOLUME}",
    "stats_from_states": f"WITH {LOG} {STATS.format('log')}",
    "daily_from_states": f"WITH {LOG} {VOLUME}",
    "stats_views": f"""
        WITH {LOG}
        SELECT 'label' AS kind, predicted_label AS name, count(*) AS n FROM log GROUP BY ALL
        UNION ALL
        SELECT 'day', strftime(created_at, '%Y-%m-%d'), count(*) FROM log GROUP BY ALL
    """,
    "recent_predictions": _recent(50),
    "recent_by_sql": _recent(20),
    "recent_from_log": _recent(50),
    "history_preview": f"WITH {HISTORY} SELECT id, heading, preview FROM lines",
    "history_panel": f"""
        WITH {HISTORY}
        SELECT id, heading, preview FROM lines ORDER BY created_at DESC, id DESC LIMIT 20
    """,
    "stream_score_log": f"""
        WITH {SCORED} SELECT doc_id, predicted_label, confidence FROM predicted
    """,
    "stream_category_stats": f"WITH {LOG} {STATS.format('log')}",
    "stream_daily_volume": f"WITH {LOG} {VOLUME}",
    "log_sources": f"""
        WITH {LOG}, {SCORED}
        SELECT 'table' AS source, CAST(0 AS BIGINT) AS batch_id, id, predicted_label, confidence
        FROM log
        UNION ALL
        SELECT 'documents', 0, doc_id, predicted_label, confidence FROM predicted
    """,
    "log_rerun_failed": f"""
        WITH {LOG}
        SELECT CAST(1 AS BIGINT) AS batch_id, id, predicted_label, confidence FROM log
    """,
    "stream_daily_volume_late": f"""
        WITH {LOG},
        marks AS (
            SELECT max(created_at) - INTERVAL 1 HOUR AS last_mark,
                   -- Late are rows of days that were final before the batch ahead of theirs ended.
                   max(created_at) FILTER (id % 10 <> 0 AND created_at < TIMESTAMP '2024-01-22')
                       - INTERVAL 1 HOUR AS mark
            FROM log
        ),
        dated AS (SELECT *, date_trunc('day', created_at) + INTERVAL 1 DAY AS day_end FROM log, marks),
        kept AS (
            SELECT *, id % 10 = 0 AND day_end <= mark AS is_late FROM dated WHERE day_end <= last_mark
        )
        SELECT strftime(created_at, '%Y-%m-%d') AS prediction_date,
               count(*) FILTER (NOT is_late) AS total, count(*) FILTER (is_late) AS late
        FROM kept GROUP BY ALL
    """,
    "stream_late_corrected": f"""
        WITH {LOG},
        marks AS (SELECT max(created_at) FILTER (id % 10 <> 0) - INTERVAL 1 HOUR AS mark FROM log)
        SELECT strftime(created_at, '%Y-%m-%d') AS prediction_date, count(*) AS total,
               count(DISTINCT predicted_label) AS unique_categories,
               count(*) FILTER (id % 10 = 0 AND date_trunc('day', created_at) + INTERVAL 1 DAY <= mark) AS late
        FROM log, marks GROUP BY ALL
    """,
    "stream_distinct_articles": "SELECT DISTINCT md5(text) AS text_md5 FROM documents",
}
