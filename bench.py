"""Headline timings at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line.

Every number is the best of two runs in one session (all kinds at
once: one run), results fully computed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from paperlantern.operators import changes as ch, folders as fo, preview as pv  # noqa: E402
from paperlantern.operators.analyze import tokenize  # noqa: E402
from paperlantern.operators.clauses import query_specs  # noqa: E402
from paperlantern.plans.index import open_index, write_index  # noqa: E402
from paperlantern.plans.search import search  # noqa: E402
from paperlantern.session import build_session, settle  # noqa: E402
from paperlantern.workload import fixtures as fx  # noqa: E402
from paperlantern.workload import queries as wq  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    scratch = tempfile.mkdtemp(prefix="paperlantern-bench-")
    spark = build_session(
        "bench", f"local[{CPUS}]",
        **{
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.sql.files.maxPartitionBytes": "2m",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": f"{scratch}/shared",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}
    roots = iter(f"{scratch}/index-{n}" for n in range(100))

    def timed(name, action, runs: int = 2) -> None:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            action()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        timings[name] = round(best, 3)

    # the corpus as files on disk would be: one row group per split
    docs_path = f"{scratch}/corpus"
    fx.documents(spark, SF).repartition(4 * int(CPUS)).write.parquet(docs_path)
    docs = spark.read.parquet(docs_path)
    text_mb = docs.agg(F.sum("size")).first()[0] / 1e6

    catalog = settle(fx.catalog(spark, SF))

    def build(positions: bool) -> str:
        root = next(roots)
        write_index(docs, root, catalog, buckets=16, positions=positions)
        return root

    timed("index_build", lambda: build(False))
    timed("index_build_with_positions", lambda: build(True))
    timed("tokenize", lambda: noop(tokenize(docs)))

    index = open_index(spark, build(True))
    texts = fx.table(spark, SF, "benchmark").orderBy("item_id").limit(100).collect()
    batch = query_specs(spark, [{"query_id": str(r.item_id), "kind": "match", "text": r.text} for r in texts])
    one = query_specs(spark, [{"query_id": "q", "kind": "match", "text": "the that"}])
    timed("search_one_query", lambda: noop(search(index, one, None, 10)))
    timed("search_100_queries", lambda: noop(search(index, batch, None, 10)))
    specs = wq._specs(spark, wq.ALL_CLAUSES)
    timed("search_all_kinds", lambda: noop(search(index, specs, None, 10)), 1)
    top = query_specs(spark, [{"query_id": "q", "occur": "must", "kind": "term", "text": "the"}])
    hits = search(index, top, None, 50).orderBy(F.desc("score"), "path").limit(1000).cache()
    hits.count()
    timed("preview_top_1000", lambda: noop(pv.match_locations(pv.preview(hits, docs, top))))
    timed("folder_tree", lambda: noop(fo.folder_tree(fo.distinct_dirs(fx.page_dirs(spark, SF)))))
    timed("debounce", lambda: noop(ch.debounce(fx.changes(spark, SF), 300)))
    timed("last_change", lambda: noop(ch.last_change(fx.changes(spark, SF))))
    timed("snapshot_diff", lambda: noop(wq.QUERIES["c8_snapshot_diff"](spark, SF)))
    print(
        json.dumps(
            {
                "metric": "total of best times", "value": round(sum(timings.values()), 3), "unit": "sec",
                "queries": timings, "sf": SF, "cpus": int(CPUS), "driver_memory": "16g",
                "text_mb": round(text_mb, 2), "index_build_mb_per_s": round(text_mb / timings["index_build"], 2),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
