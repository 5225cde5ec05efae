"""Command line, for spark-submit or ``python -m rubrika``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrika.operators import analytics, training
from rubrika.operators.encoding import with_tokens
from rubrika.operators.epochs import train_epochs
from rubrika.operators.evaluation import evaluate
from rubrika.operators.prediction_rows import prepare
from rubrika.operators.scoring import batch_predict
from rubrika.operators.token_model import fit_token_model
from rubrika.schemas import DEFAULT_VERSION, HISTORY_LIMIT, LABELS
from rubrika.session import build_session, shared_folder
from rubrika.sources import compaction, prediction_log
from rubrika.sources.corpus import head, train_and_test, with_split
from rubrika.sources.models import Model, load_stored, save_model

GRID = ((2, 0.01), (10, 0.01), (10, 0.1))


def _fit(kind: str, fitting: DataFrame, held_out: DataFrame, epochs: int, state: str | None) -> Model:
    spark = fitting.sparkSession
    if kind == "bayes":
        return fit_token_model(fitting, shared_folder(spark, "token-model"))
    if kind == "pipeline":
        return training.fit_naive_bayes(fitting)
    if kind == "logistic":
        return training.fit_logistic(fitting)
    if kind == "select":
        model, metrics = training.select_logistic(fitting, held_out, GRID)
    else:
        model, metrics = train_epochs(fitting, held_out, state or shared_folder(spark, "epochs"), epochs)
    for line in metrics:
        print(line)
    return model


KINDS = ("bayes", "pipeline", "logistic", "select", "epochs")


def _read(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return spark.read.format(args.format).load(args.input)


def train(spark: SparkSession, args: argparse.Namespace) -> None:
    """Fit on the training split, save, and show metrics of the held-out split."""
    table = _read(spark, args)
    given = [F.col("split")] if "split" in table.columns else []
    corpus = table.select(
        F.col(args.key).alias("doc_id"),
        F.col(args.text).alias("text"),
        F.col(args.label).cast("int").alias("label"),
        *given,
    )
    fitting, held_out = head(*train_and_test(with_split(corpus)), args.subset)
    clean = not args.raw
    tokens = [with_tokens(rows, clean=clean) for rows in (fitting, held_out)]
    model = _fit(args.kind, *tokens, args.epochs, args.state)
    save_model(model, args.model, args.names, clean, args.version)
    evaluate(load_stored(args.model).score(held_out, keep_probabilities=True)).show()


def score_table(spark: SparkSession, args: argparse.Namespace) -> None:
    """Score a table into a batch of the log and show how many rows were accepted."""
    on_blank = "fail" if args.strict else "keep"
    rows = load_stored(args.model).score(_read(spark, args), text=args.text, on_blank=on_blank)
    prepared = prepare(rows, key=args.key, text=args.text)
    prediction_log.append(prepared, args.log, args.batch, source=args.source, unique=args.unique)
    outcome = prediction_log.batch_outcome(spark, args.log)
    mine = (F.col("batch_id") == args.batch) & (F.col("source") == args.source)
    outcome.where(mine).show(truncate=False)


def predict(spark: SparkSession, args: argparse.Namespace) -> None:
    """Score the given texts."""
    stored = load_stored(args.model)
    rows = batch_predict(spark, stored.model, args.texts, names=stored.names, clean=stored.clean)
    rows.orderBy("position").show(truncate=False)


def stats(spark: SparkSession, args: argparse.Namespace) -> None:
    """Show predictions per label and per day."""
    log = prediction_log.read_log(spark, args.log)
    analytics.category_stats(log).show(truncate=False)
    analytics.daily_volume(log).show(truncate=False)


def recent(spark: SparkSession, args: argparse.Namespace) -> None:
    """Show the latest predictions."""
    latest = prediction_log.read_recent(spark, args.log, args.limit)
    analytics.history_lines(latest).show(args.limit, truncate=False)


def compact(spark: SparkSession, args: argparse.Namespace) -> None:
    """Write the days before a date anew, and remove what that and later attempts replaced."""
    number = compaction.compact(spark, args.log, args.before)
    print("nothing to compact" if number is None else f"compacted, number {number}")
    if args.reached is not None:
        print(f"{compaction.remove_replaced(spark, args.log, args.reached)} folders removed")


def parse(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="rubrika", description=__doc__)
    commands = parser.add_subparsers(required=True)

    def command(name, run, *options, table=False):
        sub = commands.add_parser(name, help=run.__doc__)
        sub.set_defaults(run=run)
        for option in options:
            sub.add_argument(f"--{option}", required=True)
        if table:
            sub.add_argument("--input", required=True)
            for option, default in (("format", "parquet"), ("key", "doc_id"), ("text", "text")):
                sub.add_argument(f"--{option}", default=default)
        return sub

    sub = command("train", train, "model", table=True)
    sub.add_argument("--label", default="label")
    sub.add_argument("--kind", choices=KINDS, default="bayes")
    sub.add_argument("--subset", type=int, help="first rows of the training split only")
    sub.add_argument("--names", nargs="+", default=list(LABELS), help="class names by class id")
    sub.add_argument("--version", default=DEFAULT_VERSION, help="what the log says of the model")
    sub.add_argument("--raw", action="store_true", help="take texts as they are, uncleaned")
    sub.add_argument("--epochs", type=int, default=2)
    sub.add_argument("--state", help="folder of stored epochs, to take a run up again")
    sub = command("score", score_table, "model", "log", table=True)
    sub.add_argument("--batch", type=int, required=True)
    sub.add_argument("--source", default=prediction_log.TABLE_SOURCE, help="whose batch it is")
    sub.add_argument("--strict", action="store_true", help="fail on blank texts")
    sub.add_argument("--unique", action="store_true", help="reject ids that the source holds already")
    sub = command("compact", compact, "log")
    sub.add_argument("--before", type=date.fromisoformat, required=True, help="first day that stays as it is")
    sub.add_argument("--reached", type=int, help="list number that all readers have reached; older is removed")
    command("predict", predict, "model").add_argument("texts", nargs="+")
    command("stats", stats, "log")
    command("recent", recent, "log").add_argument("--limit", type=int, default=HISTORY_LIMIT)
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> None:
    args = parse(argv)
    args.run(build_session(), args)


if __name__ == "__main__":
    main()
