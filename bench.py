"""Times the headline queries and prints one JSON line: seconds per query, each as the median of warm runs written to nowhere."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from doclake import suite
from doclake.session import session

HEADLINE = ("fixed_chunks", "sentence_chunks", "heading_chunks", "heading_chunks_max", "clean_all", "image_refs", "apply_captions", "fallback_chain", "download_name", "unique_names", "table_records", "html_to_markdown", "order_tables", "convert_documents")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session("doclake-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    found, taken = suite.queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        taken[name] = round(statistics.median(times[1:] or times), 3)
        print(name, taken[name], file=sys.stderr)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
