"""Command line: load raw files, build the marts, run the data tests, print a report.

    spark-submit mercato/__main__.py load  --data DIR --store DIR [--parents batch+stored]
    spark-submit mercato/__main__.py stream --table NAME --data DIR --progress DIR --store DIR
    spark-submit mercato/__main__.py build --store DIR [--database NAME]
    spark-submit mercato/__main__.py test  --store DIR
    spark-submit mercato/__main__.py audit --store DIR
    spark-submit mercato/__main__.py report NAME --store DIR
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

if __package__ in (None, ""):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from mercato.plans import analytics, extensions, quality  # noqa: E402
from mercato.plans.catalog import register  # noqa: E402
from mercato.plans.ingest import BATCH, BATCH_AND_STORED, load_folder  # noqa: E402
from mercato.plans.marts import MARTS, fct_orders  # noqa: E402
from mercato.schemas import LOAD_ORDER, TABLES  # noqa: E402
from mercato.session import configure_tables  # noqa: E402
from mercato.sources.csv import stream_csv  # noqa: E402
from mercato.sources.store import Store  # noqa: E402
from mercato.streaming.ingest import stream_into  # noqa: E402

REPORTS = {
    "seller_geographic_reach": analytics.seller_geographic_reach,
    "payment_installments_by_state": analytics.payment_installments_by_state,
    "monthly_revenue_trend": analytics.monthly_revenue_trend,
    "delay_impact_on_reviews": lambda tables: extensions.delay_impact_on_reviews(fct_orders(tables)),
    "revenue_by_category": extensions.revenue_by_category,
    "review_score_distribution": extensions.review_score_distribution,
    "seller_performance": extensions.seller_performance,
    "delivery_delay_summary": extensions.delivery_delay_summary,
    "geo_customers": extensions.geo_customers,
    "geo_sellers": extensions.geo_sellers,
    "trade_between_states": extensions.trade_between_states,
    "returning_shoppers": extensions.returning_shoppers,
}
AUDITS = (quality.audit_keys, quality.audit_foreign_keys, quality.audit_checks, quality.audit_not_null)


def gold(store: Store) -> Store:
    return Store(store.spark, f"{store.root}/marts")


def build(store: Store) -> dict[str, int]:
    """Rebuild all marts and return their row counts."""
    marts = gold(store)
    for name, model in MARTS.items():
        marts.overwrite(model(store), name)
    return {name: marts[name].count() for name in MARTS}


def failures(report: DataFrame, column: str) -> int:
    """Print the lines of a quality report and return how many are not zero."""
    lines = report.orderBy(*report.columns).collect()
    for line in lines:
        print(*line, sep="\t")
    return sum(line[column] > 0 for line in lines)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="mercato", description=__doc__.splitlines()[0])
    steps = parser.add_subparsers(dest="step", required=True)
    for step in ("load", "stream", "build", "test", "audit", "report"):
        options = steps.add_parser(step)
        options.add_argument("--store", required=True, help="folder that holds the tables")
        if step == "load":
            options.add_argument("--data", required=True, help="folder with the nine CSV files")
            options.add_argument("--parents", choices=(BATCH, BATCH_AND_STORED), default=BATCH)
        if step == "stream":
            options.add_argument("--table", required=True, choices=[t.name for t in LOAD_ORDER])
            options.add_argument("--data", required=True, help="folder in which the files of the table arrive")
            options.add_argument("--progress", required=True, help="folder that records which files were read")
        if step == "build":
            options.add_argument("--database", help="also register tables and marts in this catalog database")
        if step == "report":
            options.add_argument("name", choices=sorted(REPORTS))
            options.add_argument("--out", help="folder for the result; without it all rows are printed, tab-separated")
    given = parser.parse_args(arguments)

    spark = configure_tables(spark or SparkSession.builder.appName("mercato").getOrCreate())
    store = Store(spark, given.store)
    if given.step == "load":
        loaded = load_folder(spark, given.data, given.store, given.parents)
        for table, rows in loaded.inserted.items():
            print(f"{table}\t{rows} rows inserted")
        for table, _, rule, _, dropped in loaded.losses:
            if dropped:
                print(f"{table}\t{dropped} rows dropped: {rule}")
        return 0
    if given.step == "stream":
        files = stream_csv(spark, given.data, TABLES[given.table])
        stream_into(files, given.table, None, store, given.progress).awaitTermination()
        print(f"{given.table}\t{store[given.table].count()} rows stored")
        return 0
    if given.step == "build":
        for table, rows in build(store).items():
            print(f"{table}\t{rows} rows")
        if given.database:
            register(store, given.database, [t.name for t in LOAD_ORDER])
            register(gold(store), given.database, MARTS)
        return 0
    if given.step == "test":
        return min(failures(quality.quality_report(store, gold(store)), "failures"), 1)
    if given.step == "audit":
        return min(sum(failures(audit(store), "violations") for audit in AUDITS), 1)
    result = REPORTS[given.name](store)
    if given.out:
        result.write.mode("overwrite").parquet(given.out)
    else:
        print("\t".join(result.columns))
        for row in result.toLocalIterator():
            print("\t".join("" if value is None else str(value) for value in row))
    return 0


if __name__ == "__main__":
    sys.exit(main())
