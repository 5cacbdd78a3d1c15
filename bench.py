"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and threads.  Every query is run to completion over all its output columns.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.queries import QUERIES  # noqa: E402
from pairlab.session import build_session, drop_intermediates  # noqa: E402

HEADLINE = (
    "normalise_ids",
    "keep_last_features",
    "entity_universe",
    "negative_pairs",
    "assign_folds",
    "fold_leak_check",
    "assemble_pairs",
    "missing_features",
    "onehot_associations",
    "weighted_pool",
    "softmax_scores",
    "focal_loss",
    "evaluate",
    "evaluate_ranged",
    "cv_summary",
    "mean_roc_curve",
    "mean_pr_curve",
    "early_stop",
    "score_linear",
    "all_folds_predictions",
    "random_pairs",
    "prepare_splits",
    "assemble_pairs_hot",
    "modality_features",
    "projection_2d",
    "ablation",
    "cross_validate",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(small) and os.environ.get("BENCH_WARM", "1") == "1":
        for name in names:  # compile and load everything once on the smallest tables
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    spent = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.time() - start, 3)
        drop_intermediates(spark)
        print(f"{name} {spent[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
