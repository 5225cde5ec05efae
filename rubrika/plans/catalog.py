"""Every operator as a query over the given tables.

Each function takes a session and a table folder and returns a frame whose columns match the
reference SQL of the same name in ``rubrika.plans.oracles``. Times are returned as text.
"""

from __future__ import annotations

from datetime import date

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rubrika.functions import scores
from rubrika.functions.labels import label_id, label_name, zero_based
from rubrika.functions.text import TAG, clean_text, combine_title_body
from rubrika.operators import analytics, encoding, training
from rubrika.operators import epochs as epoch_training
from rubrika.operators.evaluation import evaluate
from rubrika.operators.guard import flag_blank
from rubrika.operators.prediction_rows import prepare, validate
from rubrika.operators.scoring import (
    bag_of_ids_model,
    linear_logits,
    linear_model,
    model_udf,
    score,
    with_predictions,
)
from rubrika.operators.token_model import TokenModel, fit_token_model, load_token_model
from rubrika.plans import bindings as b
from rubrika.schemas import MAX_LENGTH, VOCABULARY_SIZE
from rubrika.session import shared_folder
from rubrika.sources import compaction, prediction_log, states
from rubrika.sources.corpus import accepted, head, read_checked, read_corpus, rejected, train_and_test
from rubrika.sources.models import save_model
from rubrika.streaming import corrections, stats
from rubrika.streaming.repeats import distinct_articles
from rubrika.streaming.score import score_to_log

HEAD_SIZE = 500
LATENESS = "1 hour"
ARTICLE_SPAN = "31 days"
STATE_PARTITIONS = 8
# Which events come in which micro-batch; each list parts the whole table.
EVENT_PARTS = tuple(f"pmod(event_id, 4) = {i}" for i in range(4))
LATE_PARTS = (
    "pmod(event_id, 10) <> 0 AND ts < '2024-01-08'",
    "pmod(event_id, 10) <> 0 AND ts >= '2024-01-08' AND ts < '2024-01-15'",
    "pmod(event_id, 10) <> 0 AND ts >= '2024-01-15' AND ts < '2024-01-22'",
    "pmod(event_id, 10) <> 0 AND ts >= '2024-01-22'",
    "pmod(event_id, 10) = 0",
)
LOGISTIC_GRID = ((2, 0.01), (10, 0.01), (10, 0.1))


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def _date(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


# --- corpus and text -----------------------------------------------------------------------


def corpus_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.corpus(spark, sf_dir).select("doc_id", "label", "split")


def corpus_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus written in other formats and read back by its schema."""
    docs = b.corpus(spark, sf_dir).drop("split")
    found = []
    for source in ("json", "orc"):
        path = shared_folder(spark, f"corpus-{source}")
        docs.write.format(source).save(path)
        found.append(read_corpus(spark, path, source).withColumn("source", F.lit(source)))
    return found[0].unionByName(found[1])


def corpus_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as json lines, of which some are cut off, some have a class that is no number and
    some no text; all rows come back, the bad ones with a reason and, if unreadable, as they were."""
    path = shared_folder(spark, "corpus-lines")
    docs = b.corpus(spark, sf_dir).drop("split")
    number = F.col("doc_id").cast("string")
    line = (
        F.when(F.pmod("doc_id", F.lit(50)) == 7, F.concat(F.lit('{"doc_id": '), number, F.lit(', "text": "cut')))
        .when(
            F.pmod("doc_id", F.lit(50)) == 11,
            F.concat(F.lit('{"doc_id": '), number, F.lit(', "text": "x", "label": "none"}')),
        )
        .when(F.pmod("doc_id", F.lit(50)) == 13, F.concat(F.lit('{"doc_id": '), number, F.lit(', "label": 1}')))
        .otherwise(F.to_json(F.struct("doc_id", "text", "label")))
    )
    docs.select(line.alias("value")).write.text(path)
    rows = read_checked(spark, path, "json")
    good = accepted(rows).select("doc_id", F.md5("text").alias("text_md5"), "label")
    good = good.withColumns({"reason": F.lit(None).cast("string"), "raw": F.lit(None).cast("string")})
    bad = rejected(rows).select("doc_id", F.md5("text").alias("text_md5"), "label", "reason", F.col("_raw").alias("raw"))
    # What can be read of a record that does not fit is the reader's affair; the record itself is whole.
    read = {c: F.when(F.col("raw").isNull(), F.col(c)) for c in ("doc_id", "text_md5", "label")}
    return good.unionByName(bad.withColumns(read))


def subset_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = train_and_test(b.corpus(spark, sf_dir))
    train, test = head(train, test, HEAD_SIZE)
    return (
        train.withColumn("split", F.lit("train"))
        .union(test.withColumn("split", F.lit("test")))
        .select("split", "doc_id", "label")
    )


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents")
    return docs.select("doc_id", clean_text(F.col("text")).alias("clean"))


def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = b.table(spark, sf_dir, "pages")
    return pages.select("page_id", clean_text(F.col("html")).alias("clean"))


def clean_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs in a sentence, so that what stands around them is seen to stay."""
    pages = b.table(spark, sf_dir, "pages")
    sentence = F.concat(F.lit("see "), F.col("url"), F.lit(" for page "), F.col("page_id"))
    return pages.select("page_id", clean_text(sentence).alias("clean"))


def combine_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents")
    text = F.col("text")
    return docs.select(
        "doc_id",
        combine_title_body(b.first_line(text), b.rest(text)).alias("combined_text"),
        zero_based(b.language_class(F.col("lang")) + 1).alias("label"),
    )


def reject_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard over the text between the tags of every page, much of it blank."""
    pages = b.table(spark, sf_dir, "pages")
    parts = pages.select("page_id", F.posexplode_outer(F.split("html", TAG)).alias("part", "text"))
    parts = parts.where(F.col("part").isNotNull())
    return flag_blank(parts).select("page_id", "part", "text", "reason")


# --- encoding ------------------------------------------------------------------------------


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.token_counts(b.tokenized(spark, sf_dir))


def vocab_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are stored first, as the choice of the most frequent reads them a few times."""
    return encoding.build_vocabulary(_stored(token_counts(spark, sf_dir), "token-counts"))


def _encoded(spark: SparkSession, sf_dir: str, pad: bool) -> DataFrame:
    vocabulary = _stored(vocab_build(spark, sf_dir), "vocabulary")
    encoded = encoding.encode(b.tokenized(spark, sf_dir), vocabulary, pad=pad)
    pairs = F.arrays_zip("input_ids", "attention_mask")
    return encoded.select("doc_id", F.posexplode_outer(pairs).alias("pos", "pair")).select(
        "doc_id",
        "pos",
        F.col("pair.input_ids").alias("input_id"),
        F.col("pair.attention_mask").alias("attention"),
    )


def encode_fixed_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir, pad=True)


def encode_unpadded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir, pad=False)


def encode_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document, without padding, beside its label."""
    vocabulary = _stored(vocab_build(spark, sf_dir), "vocabulary")
    encoded = encoding.encode(b.tokenized(spark, sf_dir), vocabulary, pad=False, carry=("label",))
    return encoded.select("doc_id", "label", F.posexplode_outer("input_ids").alias("pos", "input_id"))


# --- labels and scores ---------------------------------------------------------------------


def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", "label", label_name(F.col("label")).alias("label_name"))


def label_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = b.event_label(F.col("event_type"))
    return b.table(spark, sf_dir, "events").select(
        "event_id",
        name.alias("label_name"),
        F.coalesce(label_id(name), F.lit(-1)).alias("label_id"),
    )


def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding taken as 64 logits."""
    rows = b.table(spark, sf_dir, "embeddings")
    shares = F.posexplode_outer(scores.softmax(F.col("embedding"))).alias("class_id", "share")
    return rows.select("vec_id", shares).withColumn("share", F.round("share", 6))


def _vector_predictions(rows: DataFrame) -> DataFrame:
    scored = with_predictions(rows, ranked=False)
    return scored.select("vec_id", "predicted_id", "predicted_label", "confidence")


def vector_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model in the Python workers: class means as weights of a linear model."""
    rows = b.table(spark, sf_dir, "embeddings")
    run = model_udf(linear_model(b.class_means(rows), b.LOGIT_SCALE), width=64)
    return _vector_predictions(rows.withColumn("probabilities", run("embedding")))


def vector_score_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same model as array expressions in the JVM."""
    rows = b.table(spark, sf_dir, "embeddings")
    logits = linear_logits(F.col("embedding"), b.class_means(rows), b.LOGIT_SCALE)
    return _vector_predictions(rows.withColumn("probabilities", scores.softmax(logits)))


# --- models --------------------------------------------------------------------------------


def _bayes(spark: SparkSession, sf_dir: str) -> TokenModel:
    train = train_and_test(b.corpus(spark, sf_dir))[0]
    return fit_token_model(encoding.with_tokens(train), shared_folder(spark, "token-model"))


def _bayes_scored(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return score(b.corpus(spark, sf_dir), _bayes(spark, sf_dir), **options)


def nb_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and log likelihoods per class, from the training documents."""
    train = train_and_test(b.corpus(spark, sf_dir))[0]
    fitted = fit_token_model(encoding.with_tokens(train), shared_folder(spark, "token-model"))
    model = training.log_likelihoods(fitted.counts)
    return model.select("token", "label", "n", F.round("log_prob", 6).alias("log_prob"))


def predict_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bayes_scored(spark, sf_dir).select(
        "doc_id", "predicted_id", "predicted_label", "confidence"
    )


def predict_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-length ids and mask through a model in the Python workers.

    The model sees the first 126 tokens of a document, as a model of fixed input length does.
    """
    docs = b.tokenized(spark, sf_dir)
    train = train_and_test(docs)[0]
    size = VOCABULARY_SIZE - encoding.SPECIAL_TOKENS
    every = _stored(training.class_token_counts(train), "class-counts")
    counts = _stored(training.top_tokens(every, size), "top-counts")
    vocabulary = encoding.build_vocabulary(counts)
    weights = training.id_weights(vocabulary, training.log_likelihoods(counts))
    load = bag_of_ids_model(weights, training.class_log_priors(train))
    run = model_udf(load, width=MAX_LENGTH, columns=2)
    encoded = encoding.encode(docs, vocabulary)
    shares = encoded.withColumn("probabilities", run("input_ids", "attention_mask"))
    return with_predictions(shares).select("doc_id", "predicted_id", "predicted_label", "confidence")


def scores_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = F.posexplode_outer("all_scores").alias("place", "entry")
    return _bayes_scored(spark, sf_dir).select("doc_id", ranked).select(
        "doc_id", "place", F.col("entry.label").alias("label"), F.col("entry.score").alias("score")
    )


def scores_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked scores after writing them as JSON and parsing them back."""
    text = scores.scores_to_json(F.col("all_scores"))
    ranked = F.posexplode_outer(scores.scores_from_json(text)).alias("place", "entry")
    return _bayes_scored(spark, sf_dir).select("doc_id", ranked).select(
        "doc_id", "place", F.col("entry.label").alias("label"), F.col("entry.score").alias("score")
    )


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(_bayes_scored(spark, sf_dir, keep_probabilities=True), "split")


def eval_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).select("split", "n", F.round("accuracy", 6).alias("accuracy"))


def eval_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).select("split", "n", F.round("log_loss", 4).alias("log_loss"))


def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a model that was saved and loaded."""
    path = shared_folder(spark, "model")
    save_model(_bayes(spark, sf_dir), path)
    scored = score(b.corpus(spark, sf_dir), load_token_model(spark, path))
    return scored.select("doc_id", "predicted_id", "predicted_label", "confidence")


def predict_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = train_and_test(b.corpus(spark, sf_dir))[0]
    model = training.fit_logistic(encoding.with_tokens(train))
    return score(b.corpus(spark, sf_dir), model).select(
        "doc_id", "split", "label", "predicted_id", "predicted_label", "confidence"
    )


def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = train_and_test(b.tokenized(spark, sf_dir))
    _, metrics = training.select_logistic(train, test, LOGISTIC_GRID)
    return spark.createDataFrame(
        [tuple(m.values()) for m in metrics],
        "max_iter int, reg_param double, accuracy double, log_loss double, is_best boolean",
    )


def train_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three epochs of one step over all training documents, cut after the first and taken up again."""
    train, test = train_and_test(b.tokenized(spark, sf_dir))
    path = shared_folder(spark, "epochs")
    for epochs in (1, 3):
        _, metrics = epoch_training.train_epochs(train, test, path, epochs)
    rows = spark.createDataFrame(metrics, "epoch int, n_train long, n_test long, train_loss double, "
                                 "loss double, accuracy double, is_best boolean")
    return rows.withColumns({name: F.round(name, 6) for name in ("train_loss", "loss", "accuracy")})


def predict_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the model of the best epoch."""
    train, test = train_and_test(b.tokenized(spark, sf_dir))
    model, _ = epoch_training.train_epochs(train, test, shared_folder(spark, "epochs"), 3)
    return score(b.corpus(spark, sf_dir), model).select("doc_id", "predicted_id", "predicted_label", "confidence")


# --- prediction log ------------------------------------------------------------------------


def log_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare(b.unchecked_articles(spark, sf_dir), key="id")
    return rows.select("id", "input_text", "confidence", "model_version", _time("created_at"))


def log_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate(prepare(b.unchecked_events(spark, sf_dir), key="id"))
    return rows.select("id", "predicted_label", "confidence", "status", "reason")


def log_validate_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate(prepare(b.unchecked_articles(spark, sf_dir), key="id"))
    return rows.select("id", "predicted_label", "confidence", "status", "reason")


def log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends all events twice under one batch id and reads the log back."""
    path = shared_folder(spark, "log")
    prediction_log.create_log(spark, path)
    for _ in range(2):
        rows = prepare(b.unchecked_events(spark, sf_dir), key="id")
        prediction_log.append(rows, path, batch_id=1, rebalance=True)
    return prediction_log.read_log(spark, path).select(
        "batch_id",
        "id",
        "input_text",
        "predicted_label",
        "confidence",
        "model_version",
        _time("created_at"),
        _date("prediction_date"),
    )


def log_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows an append set aside."""
    path = shared_folder(spark, "log")
    rows = prepare(b.unchecked_events(spark, sf_dir), key="id")
    prediction_log.append(rows, path, batch_id=1, rebalance=True)
    return prediction_log.read_rejected(spark, path).select("batch_id", "id", "confidence", "reason")


def log_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches in which three events each share an id, the first written twice: what the log keeps
    and what it sets aside."""
    path = shared_folder(spark, "log")
    events = b.unchecked_events(spark, sf_dir)
    first = F.pmod("id", F.lit(4)) < 2
    for batch_id, part in ((1, first), (1, first), (2, ~first)):
        rows = events.where(part).withColumn("id", F.col("id") - F.pmod("id", F.lit(3)))
        prediction_log.append(prepare(rows, key="id"), path, batch_id, rebalance=True, unique=True)
    kept = prediction_log.read_log(spark, path).select("batch_id", "id", F.lit(None).cast("string").alias("reason"))
    return kept.union(prediction_log.read_rejected(spark, path).select("batch_id", "id", "reason"))


def log_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as four batches, one of them repeated before and one after a first compaction, then a
    second one over more days, and what was replaced removed."""
    path = shared_folder(spark, "log")
    events = b.event_log(spark, sf_dir)

    def write(batch_id: int) -> None:
        prediction_log.append(events.where(F.pmod("id", F.lit(4)) == batch_id), path, batch_id, rebalance=True)

    for batch_id in (0, 1, 2, 3, 1):
        write(batch_id)
    compaction.compact(spark, path, date(2024, 1, 15))
    write(2)
    reached = compaction.compact(spark, path, date(2024, 1, 25))
    compaction.remove_replaced(spark, path, reached)
    return prediction_log.read_log(spark, path).select(
        "batch_id", "id", "predicted_label", "confidence", _date("prediction_date")
    )


def category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats_rows = analytics.category_stats(b.event_log(spark, sf_dir))
    return stats_rows.withColumn("last_seen", _time("last_seen"))


def _log_with_states(spark: SparkSession, sf_dir: str) -> str:
    """All events in four batches: one was wrong and is replaced, one has no states, old days are compacted."""
    path, events = shared_folder(spark, "log"), b.event_log(spark, sf_dir)

    def write(batch_id: int, rows: DataFrame, kept: bool = True) -> None:
        part = rows.where(F.pmod("id", F.lit(4)) == batch_id)
        prediction_log.append(part, path, batch_id, rebalance=True, states=kept)

    write(0, events)
    write(1, events.withColumn("confidence", F.lit(0.0)).withColumn("predicted_label", F.lit("World")))
    write(2, events)
    write(3, events, kept=False)
    write(1, events)
    reached = compaction.compact(spark, path, date(2024, 1, 15))
    compaction.remove_replaced(spark, path, reached)
    return path


def stats_from_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category statistics from the states of the attempts."""
    path = _log_with_states(spark, sf_dir)
    return states.category_stats(states.read_states(spark, path)).withColumn("last_seen", _time("last_seen"))


def daily_from_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = states.daily_volume(states.read_states(spark, _log_with_states(spark, sf_dir)))
    return days.withColumn("prediction_date", _date("prediction_date"))


def daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = analytics.daily_volume(b.event_log(spark, sf_dir))
    return days.withColumn("prediction_date", _date("prediction_date"))


def stats_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both views by SQL text."""
    prediction_log.register_views(b.event_log(spark, sf_dir))
    return spark.sql(
        """
        SELECT 'label' AS kind, predicted_label AS name, total_predictions AS n
        FROM category_stats
        UNION ALL
        SELECT 'day', date_format(prediction_date, 'yyyy-MM-dd'), total
        FROM daily_prediction_volume
        """
    )


def recent_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest predictions by SQL text with a parameter."""
    prediction_log.register_views(b.event_log(spark, sf_dir))
    rows = spark.sql(
        """
        SELECT id, input_text, predicted_label, confidence, created_at
        FROM predictions
        ORDER BY created_at DESC, id DESC
        LIMIT :n
        """,
        args={"n": 20},
    )
    return rows.withColumn("created_at", _time("created_at"))


def recent_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.recent_predictions(b.event_log(spark, sf_dir))
    return rows.withColumn("created_at", _time("created_at"))


def recent_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored log, reading the newest days only."""
    path = shared_folder(spark, "log")
    prediction_log.append(b.event_log(spark, sf_dir), path, batch_id=1, rebalance=True)
    rows = prediction_log.read_recent(spark, path)
    return rows.withColumn("created_at", _time("created_at"))


def history_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.history_lines(b.article_history(spark, sf_dir))


def history_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.history(b.article_history(spark, sf_dir))


def categorize_and_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, score, check, log and count: the whole way of an article.

    Rows carry the time of the run, so the batch has one day and needs no shuffle to be written.
    """
    path = shared_folder(spark, "log")
    rows = prepare(_bayes_scored(spark, sf_dir, on_blank="keep"), key="doc_id", text="text")
    prediction_log.append(rows, path, batch_id=1)
    return analytics.category_stats(prediction_log.read_log(spark, path)).drop("last_seen")


# --- streams -------------------------------------------------------------------------------


def _stream(session: SparkSession, batches: list[DataFrame], name: str) -> DataFrame:
    """Parts of a table, written one after the other, as a stream of one part per micro-batch.

    Each task writes the rows that it reads of a part. A micro-batch takes as many files as the table
    has tasks; where some have no row of a part, files with a row that the stream leaves out stand in.
    """
    path = shared_folder(session, f"stream-{name}")
    schema = batches[0].schema
    files = max(part.rdd.getNumPartitions() for part in batches)
    written = 0
    for part in batches:
        part.withColumn("_row", F.lit(True)).write.mode("append").parquet(path)
        written += files
        missing = written - len(session.read.schema(schema).parquet(path).inputFiles())
        if missing:
            blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
            blank = session.range(0, missing, 1, missing).select(*blank, F.lit(False).alias("_row"))
            blank.write.mode("append").parquet(path)
    source = session.readStream.schema(StructType([*schema]).add("_row", "boolean"))
    source = source.option("maxFilesPerTrigger", files).parquet(path)
    return source.where("_row").drop("_row")


def _event_stream(
    spark: SparkSession, sf_dir: str, conditions: tuple[str, ...] = EVENT_PARTS
) -> DataFrame:
    """Events as a stream of predictions, in a session of few shuffle partitions.

    The conditions part all events into micro-batches. Statistics combine in the tasks and keep a
    row per label or day, while every partition is a state store that each micro-batch opens and
    commits.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", STATE_PARTITIONS)
    events = b.table(session, sf_dir, "events")
    parts = [events.where(condition) for condition in conditions]
    return b.predictions(_stream(session, parts, "events"))


def stream_score_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of four micro-batches, scored into the log."""
    path, checkpoint = shared_folder(spark, "log"), shared_folder(spark, "offsets")
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = [docs.where(F.pmod("doc_id", F.lit(4)) == i) for i in range(4)]
    articles = _stream(spark, parts, "documents")
    score_to_log(articles, _bayes(spark, sf_dir), path, checkpoint).awaitTermination()
    return prediction_log.read_log(spark, path).select(
        F.col("id").alias("doc_id"), "predicted_label", "confidence"
    )


def log_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table and a stream in one log, under the same batch numbers, both whole."""
    path, checkpoint = shared_folder(spark, "log"), shared_folder(spark, "offsets")
    prediction_log.append(b.event_log(spark, sf_dir), path, batch_id=0, rebalance=True)
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "text")
    articles = _stream(spark, [docs], "documents")
    model = _bayes(spark, sf_dir)
    score_to_log(articles, model, path, checkpoint, source="documents").awaitTermination()
    return prediction_log.read_log(spark, path).select(
        "source", "batch_id", "id", "predicted_label", "confidence"
    )


def log_rerun_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch whose second attempt fails half-way keeps the rows of its first."""
    path = shared_folder(spark, "log")
    rows = b.event_log(spark, sf_dir)
    prediction_log.append(rows, path, batch_id=1, rebalance=True)
    broken = F.when(F.col("id") >= 0, F.raise_error(F.lit("a task fails")).cast("double"))
    try:
        prediction_log.append(rows.withColumn("confidence", broken), path, batch_id=1)
    except PySparkException:
        return prediction_log.read_log(spark, path).select(
            "batch_id", "id", "predicted_label", "confidence"
        )
    raise ValueError("the second attempt should have failed")


def _running(spark: SparkSession, result: DataFrame, mode: str) -> DataFrame:
    path, checkpoint = shared_folder(spark, "running"), shared_folder(spark, "offsets")
    stats.write_running(result, path, checkpoint, mode).awaitTermination()
    if mode == "append":
        return spark.read.schema(result.schema).parquet(path)
    return stats.read_running(spark, path, result.schema)


def stream_category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _event_stream(spark, sf_dir)
    counted = _running(spark, stats.running_category_stats(events), "complete")
    return counted.withColumn("last_seen", _time("last_seen"))


def stream_daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _event_stream(spark, sf_dir)
    days = _running(spark, stats.daily_volume_by_window(events), "complete")
    return days.withColumn("prediction_date", _date("prediction_date"))


def stream_daily_volume_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that are final under a watermark, with the rows that came too late for them.

    Events come in order but for a tenth, which follows in the last micro-batch.
    """
    events = _event_stream(spark, sf_dir, LATE_PARTS)
    days = _running(spark, stats.daily_volume_by_window(events, LATENESS), "append")
    whole = analytics.daily_volume(b.event_log(spark, sf_dir))
    whole = whole.select("prediction_date", F.col("total").alias("arrived"))
    return days.join(whole, "prediction_date").select(
        _date("prediction_date"), "total", (F.col("arrived") - F.col("total")).alias("late")
    )


def stream_late_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days with every row, and how many of them came after their day was final."""
    events = _event_stream(spark, sf_dir, LATE_PARTS)
    path, checkpoint = shared_folder(spark, "days"), shared_folder(spark, "offsets")
    query = corrections.corrected_daily_volume(events, LATENESS, path, checkpoint)
    query.awaitTermination()
    days = corrections.read_corrected(events.sparkSession, path, query.id)
    return days.select(_date("prediction_date"), "total", "unique_categories", "late")


def stream_distinct_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different texts of a stream whose copies come in other micro-batches, by their hash."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", STATE_PARTITIONS)
    docs = b.table(session, sf_dir, "documents")
    docs = docs.select("text", b.article_time(F.col("doc_id")).alias("created_at"))
    parts = [docs.where(F.pmod(F.xxhash64("created_at"), F.lit(4)) == i) for i in range(4)]
    fresh = distinct_articles(_stream(session, parts, "articles"), ARTICLE_SPAN)
    return _running(session, fresh.select(F.md5("text").alias("text_md5")), "append")


QUERIES = {
    "categorize_and_log": categorize_and_log,
    "corpus_split": corpus_split,
    "corpus_formats": corpus_formats,
    "corpus_malformed": corpus_malformed,
    "subset_head": subset_head,
    "clean_documents": clean_documents,
    "clean_pages": clean_pages,
    "clean_urls": clean_urls,
    "combine_title_body": combine_title,
    "reject_blank": reject_blank,
    "token_counts": token_counts,
    "vocab_build": vocab_build,
    "encode_fixed_length": encode_fixed_length,
    "encode_unpadded": encode_unpadded,
    "encode_labelled": encode_labelled,
    "label_lookup": label_lookup,
    "label_inverse": label_inverse,
    "softmax_scores": softmax_scores,
    "vector_score": vector_score,
    "vector_score_columns": vector_score_columns,
    "nb_model": nb_model,
    "predict_nb": predict_nb,
    "predict_encoded": predict_encoded,
    "scores_ranked": scores_ranked,
    "scores_json_roundtrip": scores_json_roundtrip,
    "eval_accuracy": eval_accuracy,
    "eval_log_loss": eval_log_loss,
    "model_roundtrip": model_roundtrip,
    "predict_lr": predict_lr,
    "model_selection": model_selection,
    "train_epochs": train_epochs,
    "predict_epochs": predict_epochs,
    "log_prepare": log_prepare,
    "log_validate": log_validate,
    "log_validate_articles": log_validate_articles,
    "log_append": log_append,
    "log_rejected": log_rejected,
    "log_repeated_ids": log_repeated_ids,
    "log_compacted": log_compacted,
    "log_sources": log_sources,
    "log_rerun_failed": log_rerun_failed,
    "category_stats": category_stats,
    "daily_volume": daily_volume,
    "stats_from_states": stats_from_states,
    "daily_from_states": daily_from_states,
    "stats_views": stats_views,
    "recent_predictions": recent_predictions,
    "recent_by_sql": recent_by_sql,
    "recent_from_log": recent_from_log,
    "history_preview": history_preview,
    "history_panel": history_panel,
    "stream_score_log": stream_score_log,
    "stream_category_stats": stream_category_stats,
    "stream_daily_volume": stream_daily_volume,
    "stream_daily_volume_late": stream_daily_volume_late,
    "stream_late_corrected": stream_late_corrected,
    "stream_distinct_articles": stream_distinct_articles,
}
