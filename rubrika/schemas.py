"""Row shapes and limits shared by the whole package."""

from __future__ import annotations

from pyspark.sql import types as T

# Category names by class id, and the name given to any other id.
LABELS = ("World", "Sports", "Business", "Science/Technology")
UNKNOWN_LABEL = "Unknown"

# Encoding length, vocabulary size of the uncased base model.
MAX_LENGTH = 128
VOCABULARY_SIZE = 30522

# Limits and defaults of the prediction log.
MAX_INPUT_CHARS = 4000
MAX_LABEL_CHARS = 64
MAX_VERSION_CHARS = 128
DEFAULT_VERSION = "v1.0"
RECENT_LIMIT = 50
HISTORY_LIMIT = 20
PREVIEW_CHARS = 300

SCORES = T.ArrayType(
    T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
)

ARTICLES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("input_text", T.StringType()),
        T.StructField("predicted_label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("all_scores", SCORES),
        T.StructField("model_version", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# The stored form: one table holds accepted and rejected rows, apart by partition.
LOG_TABLE = T.StructType(
    [
        *PREDICTIONS.fields,
        T.StructField("reason", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("run", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("attempt", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("prediction_date", T.DateType()),
    ]
)

# What an attempt holds, by status and day.
LOG_COUNTS = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("prediction_date", T.DateType()),
        T.StructField("n", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("run", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("attempt", T.StringType()),
    ]
)

# What the accepted rows of an attempt, day and label add to the statistics.
STATES = T.StructType(
    [
        T.StructField("prediction_date", T.DateType()),
        T.StructField("predicted_label", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("sum_confidence", T.DecimalType(30, 15)),
        T.StructField("n_confidence", T.LongType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("run", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("attempt", T.StringType()),
    ]
)

# An entry of the log's list: an attempt of a batch, or a compaction (then ``attempt`` is its name).
# ``keyed`` says that the attempt's ids are in the key table.
LOG_LIST = T.StructType(
    [
        T.StructField("number", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("run", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("attempt", T.StringType()),
        T.StructField("keyed", T.BooleanType()),
    ]
)

# Rows of closed days, written anew by a compaction, and what it holds of which attempt.
COMPACTED = T.StructType(
    [*[f for f in LOG_TABLE if f.name not in ("status", "prediction_date")]]
    + [
        T.StructField("compaction", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("prediction_date", T.DateType()),
    ]
)
PIECES = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("prediction_date", T.DateType()),
        T.StructField("attempt", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("compaction", T.StringType()),
    ]
)

# The ids of accepted rows, by bucket of their hash.
KEYS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("attempt", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("run", T.StringType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)
