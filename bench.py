"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

HEADLINE = [
    "scan_triples", "infer_types", "entity_cbd_size", "fingerprint", "duplicate_values", "mint_uris", "replace_uri", "upsert_decision", "version_append", "latest_version", "json_path_first", "tokens_simple", "postings_weighted",
    "search_bool", "search_phrase", "search_rank",
]
REPEAT = int(os.environ.get("BENCH_REPEAT", "1"))


def main() -> None:
    here = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, here)
    os.environ["PYTHONPATH"] = here + os.pathsep + os.environ.get("PYTHONPATH", "")
    from pyspark.sql import SparkSession

    from quillgraph.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["entity_cbd_size"](spark, os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")).write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(REPEAT):
            began = time.monotonic()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.monotonic() - began)
        took[name] = round(median(runs), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
