"""Searches for the rules that shorten a corpus of files and, with a store, publishes the best: python -m byteloom FILE... [--store FOLDER]."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import functions as F

from byteloom.operators import evolve
from byteloom.session import session, ship
from byteloom.sources import snapshots, streams

PRESETS = {"default": evolve.DEFAULT, "fast": evolve.FAST, "thorough": evolve.THOROUGH}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="byteloom", description=__doc__)
    p.add_argument("files", nargs="*", help="files of the corpus; without any, the default corpus")
    p.add_argument("--preset", choices=sorted(PRESETS), default="fast")
    p.add_argument("--generations", type=int, help="in place of the preset's number")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--domain", default="", help="the tag of what is published")
    p.add_argument("--store", help="a folder of snapshots, shared with the executors")
    p.add_argument("--master", default="local[*]")
    return p


def main(argv: list[str] | None = None) -> str:
    """Prints and returns the run's report."""
    from dataclasses import replace

    args = parser().parse_args(argv)
    spark = ship(session("byteloom", args.master))
    config = PRESETS[args.preset] if args.generations is None else replace(PRESETS[args.preset], generations=args.generations)
    corpus = streams.files(spark, *args.files) if args.files else streams.seed(spark)
    start = time.time()
    harness = evolve.Harness(corpus, config, args.seed).start()
    rules = harness.join()
    history = spark.createDataFrame(harness.history)
    text = evolve.report_text(history, harness.control, args.domain, time.time() - start)
    if args.store:
        new = snapshots.publish_rules(spark, args.store, rules, args.domain, len(harness.history), int(time.time() * 1000))
        text += "".join(f"\n  Published          : {r.id}" for r in new.where(F.col("domain") == args.domain).collect())  # one chromosome
    print(text)
    return text


if __name__ == "__main__":
    main()
