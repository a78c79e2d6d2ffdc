"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the number of local threads. Every query runs once to warm up and
once for the record; the result is written to the no-op sink, so all columns of all rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "information_value",
    "describe_numeric",
    "numeric_moments",
    "numeric_percentiles",
    "iqr_outlier_report",
    "column_basics",
    "categorical_profile",
    "string_pattern_profile",
    "anova_f",
    "winsorize",
    "sentinel_to_null",
    "impute_median",
    "impute_mode",
    "forward_fill",
    "label_encode",
    "target_encode",
    "tx_quantile",
    "tx_standardize",
    "woe_table",
    "correlation_matrix",
    "vif",
    "csi",
    "apply_plan",
    "recommend_outliers",
    "classification_metrics",
    "roc_auc",
    "rank_ordering",
    "keyword_label",
    "nearest_prototype_label",
    "stream_csi",
)


def main() -> None:
    from sparkprep import catalog
    from sparkprep.session import get_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalog.load()
    wanted = sys.argv[1:] or HEADLINE
    took = {}
    for name in wanted:
        for _ in range(2):
            start = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - start, 3)
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(folder.rstrip("/")),
                "lineitem_rows": rows,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
