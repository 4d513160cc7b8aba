"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_RUNS the timed runs of each query after
one warm-up (the median counts). `--sql` times the SQL of each query in DuckDB as well.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

HEADLINE = (
    "kshot_train", "seed_task_grid", "full_set", "render_prompt", "encode_features", "build_vocab", "encode_ids",
    "knn_exact", "knn_exact_blocks", "knn_ivf", "index_partitions", "bm25_index", "bm25_topk", "attach_neighbors",
    "fuse_ordered_mask_add", "fuse_mixture", "search_fusion", "log_softmax", "argmax_predict", "collate_batches",
    "f1_binary", "spearman", "metric_dispatch", "grid_report", "fewshot_predict",
)


def timed(run, runs: int) -> float:
    run()
    seconds = []
    for _ in range(runs):
        begun = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - begun)
    return round(statistics.median(seconds), 3)


def main() -> None:
    from shotgrove.plans.catalog import QUERIES, SQL
    from shotgrove.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [a for a in sys.argv[1:] if not a.startswith("-")] or list(HEADLINE)
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {n: timed(lambda n=n: QUERIES[n](spark, folder).write.format("noop").mode("overwrite").save(), runs)
               for n in names}
    result = {"metric": "sum of median seconds of the headline queries", "value": round(sum(seconds.values()), 3),
              "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}
    if "--sql" in sys.argv:
        from tests.compare import connect

        db = connect(folder)
        db.execute(f"SET threads = {cpus}")
        result["sql"] = {n: timed(lambda n=n: db.execute(SQL[n]).fetchall(), runs) for n in names if n in SQL}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
