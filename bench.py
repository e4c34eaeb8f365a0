"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from amberline.plans import queries
from amberline.session import build_session

HEADLINE = (
    "wn03_trailing_features", "wn04_channel_features", "wn10_sma2_within", "wn15_sustained_lead", "wn18_sustained_signal_lead",
    "wn20_lag_autocorrelation", "ag03_rates_by_band", "ag05_honest_metrics", "ag07_concentration", "ag11_metric_by_cut",
    "ag12_quintile_ticket_cut", "ag20_duplicate_keys", "ag21_impossible_states", "ev01_auc", "ev04_recall_at_budget", "ev06_deciles",
    "ev10_rank_order_exhibit", "ev13_ece_equal_count", "ev21_feature_csi_table", "ev23_cluster_bootstrap", "th04_pick", "th07_sensitivity",
    "sp02_three_way_split", "sp05_stratified_sample", "sp09_permute_labels", "gr01_partner_counts", "pr24_reason_codes",
    "pr21_financial_ratios", "ml03_scorecard", "ss03_daily_conduct",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.log.level": "OFF", "spark.ui.showConsoleProgress": "false"})
    registered = queries()
    registered["ev01_auc"](spark, sf_dir).count()  # warm the JVM, not timed
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
