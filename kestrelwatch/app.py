"""Command line: run the state monitor or the failure detector on a stream.

  python -m kestrelwatch.app monitor rules.yml --store /shared/monitor
  python -m kestrelwatch.app train counts_events/ --models /shared/models
  python -m kestrelwatch.app detect --models /shared/models --topic events --servers host:9092 --out /shared/alerts
"""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelwatch.functions.texts import transition_text
from kestrelwatch.operators import normalise, outliers
from kestrelwatch.operators.alerts import state_alerts
from kestrelwatch.rules import load_rules
from kestrelwatch.session import get_session
from kestrelwatch.sources.readers import kafka_options, read_stream
from kestrelwatch.sources.schema import load_schema
from kestrelwatch.sources.writers import write_alert_lines
from kestrelwatch.streaming import detector, monitor


def _messages(spark: SparkSession, args, servers: str | None, topic: str | None, starting: str) -> DataFrame:
    if args.source == "kafka":
        if not servers or not topic:
            raise SystemExit("a Kafka source needs servers and a topic")
        return read_stream(spark, "kafka", **kafka_options(servers, topic, starting))
    return read_stream(spark, args.source, args.path, "key string, value string")


def run_monitor(spark: SparkSession, args) -> None:
    """Everything a rule file describes: source, schema, rules, run interval, alert file."""
    rules = load_rules(args.rules)
    schema = load_schema(rules.schema_file) if rules.schema_file else normalise.EVENT_SCHEMA
    # Repeated messages need no stream state here: equal transitions count once in every run, however late they come.
    events = normalise.parse_messages(_messages(spark, args, rules.bootstrap_servers, rules.topic, "latest"), schema)
    started = datetime.now(timezone.utc)
    out = args.out or rules.alert_file or f"{args.store}/alerts"

    def sink(missing: DataFrame, warnings: DataFrame, batch_id: int) -> None:
        alerts = state_alerts(missing, rules, started_at=started)
        write_alert_lines(alerts.filter("not suppressed"), f"{out}/alerts", batch_id)
        write_alert_lines(alerts.filter("suppressed"), f"{out}/suppressed", batch_id)
        told = warnings.select(transition_text(rules, F.lit(False)).alias("value"))
        told.write.mode("overwrite").text(f"{out}/warnings/batch={batch_id}")

    trigger = {"availableNow": True} if args.once else None
    stream = events if args.once else monitor.heartbeat(events)
    query = monitor.monitor_stream(stream, rules, args.store, f"{args.store}/checkpoint", sink, trigger=trigger)
    query.awaitTermination()


def run_train(spark: SparkSession, args) -> None:
    """Fit and keep the models from stored messages."""
    events = normalise.parse_messages(spark.read.parquet(args.path))
    features, model = outliers.train(detector.failure_counts(events), args.model, "keep")
    outliers.save_models(features, model, args.models)


def run_detect(spark: SparkSession, args) -> None:
    events = normalise.parse_messages(_messages(spark, args, args.servers, args.topic, "latest"))
    features, model = outliers.load_models(args.models, args.model)
    stored = normalise.parse_messages(spark.read.parquet(args.events)) if args.events else None
    query = detector.detect_stream(
        events, features, model, lambda alerts, i: write_alert_lines(alerts, args.out, i), f"{args.out}-checkpoint", stored,
        trigger={"availableNow": True} if args.once else None,
    )
    query.awaitTermination()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kestrelwatch", description=__doc__.splitlines()[0])
    commands = top.add_subparsers(required=True)

    def command(name: str, run, stream: bool = True) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=run.__doc__)
        sub.set_defaults(run=run)
        if stream:
            sub.add_argument("--source", default="kafka", help="kafka, or a file format such as parquet or json")
            sub.add_argument("--path", help="folder to read, for a file source")
            sub.add_argument("--once", action="store_true", help="process what is there and stop")
            sub.add_argument("--out", help="folder for alerts")
        return sub

    sub = command("monitor", run_monitor)
    sub.add_argument("rules", help="rule file")
    sub.add_argument("--store", required=True, help="shared folder for the monitor's tables")
    sub = command("train", run_train, stream=False)
    sub.add_argument("path", help="stored messages")
    sub.add_argument("--models", required=True)
    sub.add_argument("--model", default="logistic", choices=sorted(outliers.MODELS))
    sub = command("detect", run_detect)
    sub.add_argument("--models", required=True)
    sub.add_argument("--model", default="logistic", choices=sorted(outliers.MODELS))
    sub.add_argument("--servers")
    sub.add_argument("--topic")
    sub.add_argument("--events", help="table of the same messages, for event references")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(get_session(), args)


if __name__ == "__main__":
    main()
