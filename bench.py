"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

The loading steps run once, from the raw tables to the store. The queries then run over the stored
tables, as the published baseline does: two warm-ups, then the median of $BENCH_RUNS runs, or of as
many as start within ten seconds.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame  # noqa: E402

from mercato.plans import analytics, extensions, quality  # noqa: E402
from mercato.plans.clean import clean  # noqa: E402
from mercato.plans.ingest import ingest  # noqa: E402
from mercato.plans.marts import MARTS, dim_dates, fct_orders  # noqa: E402
from mercato.session import fresh_path, local_session  # noqa: E402
from mercato.sources.layout import bucket_by_order  # noqa: E402
from mercato.sources.sample import raw_tables  # noqa: E402
from mercato.sources.store import Store  # noqa: E402


def run(df: DataFrame) -> None:
    """Compute every row and column, write nothing."""
    df.write.format("noop").mode("overwrite").save()


def timed(action: Callable[[], object]) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = local_session(cores, name="bench")
    spark.sparkContext.setLogLevel("ERROR")

    raw = raw_tables(spark, folder)
    store = Store(spark, fresh_path(spark, "bench_store"))
    gold = Store(spark, fresh_path(spark, "bench_gold"))
    times = {
        "ingest_first": timed(lambda: ingest(raw, store)),
        "ingest_again": timed(lambda: ingest(raw, store)),
        "build_marts": timed(lambda: [gold.overwrite(model(store), name) for name, model in MARTS.items()]),
    }
    bucketed: dict[str, DataFrame] = {}
    times["bucket_by_order"] = timed(
        lambda: bucketed.update(bucket_by_order(store, fresh_path(spark, "bench_buckets"), int(cores), "bench_"))
    )

    def cleaning() -> None:
        for name in raw:
            run(clean(name, raw[name], store))

    actions: dict[str, Callable[[], object]] = {
        "seller_geographic_reach": lambda: run(analytics.seller_geographic_reach(store)),
        "seller_geographic_reach_bucketed": lambda: run(analytics.seller_geographic_reach(bucketed)),
        "payment_installments_by_state": lambda: run(analytics.payment_installments_by_state(store)),
        "monthly_revenue_trend": lambda: run(analytics.monthly_revenue_trend(store)),
        "fct_orders": lambda: run(fct_orders(store)),
        "fct_orders_bucketed": lambda: run(fct_orders(bucketed)),
        "dim_dates": lambda: run(dim_dates(store)),
        "clean_all_tables": cleaning,
        "quality_report": lambda: run(quality.quality_report(store, gold)),
        "audit_foreign_keys": lambda: run(quality.audit_foreign_keys(raw)),
        "revenue_by_category": lambda: run(extensions.revenue_by_category(store)),
        "seller_performance": lambda: run(extensions.seller_performance(store)),
        "trade_between_states": lambda: run(extensions.trade_between_states(store)),
    }
    for name, action in actions.items():
        action()
        action()
        measured: list[float] = []
        while len(measured) < runs and sum(measured) < 10:
            measured.append(timed(action))
        times[name] = round(statistics.median(measured), 3)

    print(
        json.dumps(
            {
                "metric": "marketplace_pipeline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(Path(folder).name.removeprefix("sf") or 0),
            }
        )
    )


if __name__ == "__main__":
    main()
