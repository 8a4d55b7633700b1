from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import PARENT_ORDERS, raw_text, tuples, typed
from mercato.schemas import PAYMENTS
from mercato.sources.csv import stream_csv
from mercato.sources.store import Store
from mercato.streaming.ingest import stream_into


@pytest.fixture
def arriving(spark, tmp_path):
    folder = str(tmp_path / "arriving")

    def land(rows):
        names = ("order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value")
        raw_text(spark, "payments", [dict(zip(names, r)) for r in rows]).coalesce(1).write.mode("append").parquet(
            folder
        )
        return folder

    return land


def test_new_files_are_loaded_once(spark, tmp_path, arriving):
    parents = {"orders": typed(spark, "orders", PARENT_ORDERS)}
    store = Store(spark, str(tmp_path / "store"))

    def stream(progress):
        folder = str(tmp_path / "arriving")
        files = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
        stream_into(files, "payments", parents, store, str(tmp_path / progress)).awaitTermination()
        return sorted(tuples(store["payments"].select("order_id", "payment_sequential", "payment_value")))

    arriving([("o1", "1", "boleto", "1", "5"), ("o1", "1", "boleto", "1", "6"), ("zz", "1", "boleto", "1", "5")])
    first = stream("progress")
    assert [(o, n, str(v)) for o, n, v in first] == [("o1", 1, "5.00")]
    # Nothing new; then a known key with another value beside a new one; then everything again.
    assert stream("progress") == first
    arriving([("o1", "1", "boleto", "1", "9"), ("o2", "1", "boleto", "1", "7")])
    second = stream("progress")
    assert [(o, n, str(v)) for o, n, v in second] == [("o1", 1, "5.00"), ("o2", 1, "7.00")]
    assert stream("fresh progress") == second
    assert store["payments"].where(F.col("order_id") == "zz").isEmpty()


def test_csv_files_as_they_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    header = ",".join(PAYMENTS.columns) + "\n"
    (tmp_path / "in" / "a.csv").write_text(header + "o1,1,boleto,1,5\no1,1,boleto,1,6\no1,2,NA,1,6\n")
    parents = {"orders": typed(spark, "orders", PARENT_ORDERS)}
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        rows = stream_csv(spark, str(tmp_path / "in"), PAYMENTS)
        stream_into(rows, "payments", parents, store, str(tmp_path / "progress")).awaitTermination()
        (tmp_path / "in" / "b.csv").write_text(header + "o1,1,boleto,1,9\no3,1,voucher,3,2\n")
    got = store["payments"].select("order_id", "payment_sequential", F.col("payment_value").cast("string"))
    assert sorted(tuples(got)) == [("o1", 1, "5.00"), ("o3", 1, "2.00")]
