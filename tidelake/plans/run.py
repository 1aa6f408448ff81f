"""Runs a layer, or all of them, from the command line: python -m tidelake.plans.run ROOT LANDING --layer gold --pipeline batch"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from tidelake.plans.pipeline import Pipeline, reset
from tidelake.sources.events import Broker, Folder


def parameters(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("root", help="where tables and state are kept")
    parser.add_argument("landing", help="where files arrive, a folder for each bronze table")
    parser.add_argument("--layer", choices=["all", "bronze", "silver", "gold", "reset"], default="all")
    parser.add_argument("--pipeline", choices=["batch", "streaming"], help="only tables of this pipeline")
    parser.add_argument("--events", help="a folder of messages, or host:port/topic of a broker")
    parser.add_argument("--confirm", action="store_true", help="needed for reset")
    return parser.parse_args(argv)


def event_source(given: str | None) -> Broker | Folder | None:
    if not given:
        return None
    server, _, topic = given.partition("/")
    return Broker(server, topic) if ":" in server and server and topic and not topic.startswith("/") else Folder(given)


def run(spark: SparkSession, args: argparse.Namespace) -> dict | list:
    pipe, events = Pipeline(spark, args.root, args.landing), event_source(args.events)
    if args.layer == "reset":
        return reset(pipe, args.confirm)
    steps = {"bronze": lambda: pipe.run_bronze(events), "silver": lambda: pipe.run_silver(args.pipeline), "gold": lambda: pipe.run_gold(args.pipeline)}
    return {name: step() for name, step in steps.items() if args.layer in ("all", name)}


if __name__ == "__main__":
    from tidelake.session import build_session

    print(json.dumps(run(build_session("run"), parameters()), default=str))
