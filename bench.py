"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from arbitra.plans import QUERIES
from arbitra.plans.base import table
from arbitra.plans.weights import quality_hashed, quality_model
from arbitra.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "hashed_tf", "fit_vocab", "tfidf_weights", "score_hashed", "score_tfidf", "ask", "decision_mix", "ask_batch",
    "ask_hybrid", "decompose", "fit_temperature", "ece", "auroc", "auroc_by_type", "latency_summary", "best_stump",
    "split_halves", "cap_per_class", "build_pairs", "drop_probe_overlap", "aug_cancel",
    "ask_stream", "define", "train_hashed", "train_tfidf", "calibrate",
]


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]", int(CPUS),
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(df) -> float:
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(QUERIES["tokens_word"](spark, SF_DIR))  # warm up
    times: dict[str, float] = {}
    for name, fit in (("fit_quality_model", quality_model), ("fit_quality_hashed", quality_hashed)):
        start = time.perf_counter()
        fit(spark, SF_DIR)
        times[name] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        run(QUERIES[name](spark, SF_DIR))
        times[name] = round(time.perf_counter() - start, 3)
    docs = table(spark, SF_DIR, "documents").count()
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(SF_DIR.rstrip("/").rsplit("sf", 1)[-1]),
        "documents": docs,
        "documents_scored_per_sec": {q: round(docs / times[q], 1) for q in ("score_hashed", "score_tfidf", "ask")},
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
