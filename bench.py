"""Seconds of headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: the median of three warm runs each, the containers' ratios over all bytes, and whether
streams came back from them. Prints one line of JSON."""

import json
import os
import statistics
import time

os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from byteloom.session import session  # noqa: E402

HEADLINE = ["digrams", "document_digrams", "edges", "graph_stats", "patterns", "v2_size", "v1_size", "v1_size_documents", "fingerprint", "fingerprint_lineitem", "population_fitness", "cycles", "snapshot_dedup"]


def main() -> None:
    from byteloom.plans.queries import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            start = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    ratios = {}
    for name in ("v1_size", "v1_size_documents", "v2_size"):
        r = QUERIES[name](spark, sf).agg(F.sum("encoded_bytes").alias("to"), F.sum("n").alias("n")).first()
        ratios[name] = round(r.to / r.n, 6)
    back = {name: QUERIES[name](spark, sf).where("not equal").isEmpty() for name in ("v1_cycle_roundtrip", "v2_roundtrip", "v3_roundtrip")}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "ratios": ratios, "round_trips": back, "sf": float(os.path.basename(sf.rstrip("/")).removeprefix("sf") or 0)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
