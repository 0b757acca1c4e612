"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from tessera.plans import registry

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# Each query runs in a session of its own, so none finds facts that another one has checkpointed.
HEADLINE = ["txt_facts", "html_facts", "direct_extract_baseline", "markdown_facts", "all_metrics", "document_score", "corpus_compare", "plan_operations",
            "collision_suffix", "dedupe_by_hash", "tokenize", "render_document", "progress_history", "docx_facts", "xlsx_facts"]


def main() -> None:
    shared = os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-shared-")
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.checkpoint.dir", shared)
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.codegen.cache.maxEntries", "2000").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        session = spark.newSession()
        start = time.perf_counter()
        registry.QUERIES[name](session, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
