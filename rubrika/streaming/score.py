"""Scoring a stream of articles into the prediction log."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rubrika.operators.prediction_rows import prepare
from rubrika.operators.scoring import score
from rubrika.operators.token_model import TokenModel
from rubrika.sources.prediction_log import append, runs
from rubrika.streaming.identity import query_id


def score_to_log(
    articles: DataFrame,
    model: PipelineModel | TokenModel,
    log_path: str,
    checkpoint: str,
    key: str = "doc_id",
    text: str = "text",
    source: str | None = None,
    replace: bool = False,
    rebalance: bool = False,
    unique: bool = False,
    **trigger,
) -> StreamingQuery:
    """Starts a query that scores each micro-batch and writes it as one batch of the log.

    A micro-batch is handled as any table is: scoring keeps no state, and blank texts go to the
    rejected rows. Its number names the batch within the source and the run, which is the
    query's id as its checkpoint keeps it, so a replay after a failure replaces what it wrote
    before. Without a name the source is the query itself. A named source refuses a query with
    new offsets, which would hold the same rows under other numbers, unless ``replace`` says that
    the new run takes the place of the older ones; their rows then leave the log as soon as the new
    run's first micro-batch is complete.
    """
    checked = []

    def write(batch: DataFrame, epoch: int) -> None:
        run = query_id(batch)
        name = source or f"stream-{run}"
        if not checked and not replace:
            others = runs(batch.sparkSession, log_path, name) - {run}
            if others:
                raise ValueError(f"source {name} has a run with other offsets: {sorted(others)}")
            checked.append(run)
        scored = score(batch, model, text=text, on_blank="keep")
        rows = prepare(scored, key=key, text=text)
        append(rows, log_path, epoch, rebalance, name, run, unique)

    return (
        articles.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
