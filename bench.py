"""Times the headline queries over one scale and prints one JSON line.

Each query is run twice into Spark's noop sink and the faster run counts, so class loading is left out.
"""

from __future__ import annotations

import importlib
import json
import os
import sys
import time
from pathlib import Path

HERE = Path(__file__).resolve().parent
HEADLINE = (
    "index_by_flow coverage_by_company index_by_tier coverage_rollup org_leaderboard progress_over_time facts_build cube_currency facets citation_graph_1hop bm25_topk hybrid_case_rank dense_exact_topk two_stage_dense opportunity_top5 "
    "page_text norm_text chunk_paragraphs case_chunks page_gutters cohen_kappa tumbling_counts session_users "
    "op1_pii_spans op2_mix_sources op3_license_sentences op4_quality_divergence op5_simhash_groups op6_packing op7_attention_lm op8_url_rules op9_winnowing op10_toxicity op11_ngram_join op12_spelling op13_hard_negatives"
).split()


def main() -> None:
    sys.path.insert(0, str(HERE))
    os.environ["PYTHONPATH"] = f"{HERE}:{os.environ.get('PYTHONPATH', '')}"
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = importlib.import_module("__spark_entry__").queries(), {}
    for name in sys.argv[1:] or HEADLINE:
        if name not in queries:
            continue
        runs = []
        for _ in range(2):
            began = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
            if runs[0] > 30:
                break
        took[name] = round(min(runs), 3)
        print(f"{name} {took[name]}", file=sys.stderr)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
