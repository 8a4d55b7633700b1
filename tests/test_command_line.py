from __future__ import annotations

import pytest

from mercato.__main__ import main
from mercato.schemas import LOAD_ORDER, TABLES

ROWS = {
    "geolocation": "1037,-23.5,-46.6,sao paulo,SP",
    "product_category_name_translation": "bebes,baby",
    "customers": "c1,u1,1037,sao paulo,SP",
    "sellers": "s1,1037,sao paulo,SP",
    "products": "p1,bebes,5,10,1,100,10,10,10",
    "orders": "o1,c1,delivered,2017-10-02 10:56:33,,,2017-10-10 00:00:00,2017-10-18 00:00:00",
    "order_items": "o1,1,p1,s1,2017-10-06 11:07:15,29.99,8.72",
    "payments": "o1,1,credit_card,2,38.71",
    "order_reviews": "r1,o1,4,,,2017-10-11 00:00:00,2017-10-12 03:43:48",
}


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    (root / "data").mkdir()
    for table in LOAD_ORDER:
        text = ",".join(table.columns) + "\n" + ROWS[table.name] + "\n"
        (root / "data" / table.file.replace("*", "shop_").replace("__", "_")).write_text(text)
    return root


def test_whole_pipeline(spark, folders, capsys):
    store = ["--store", str(folders / "store")]
    load = ["load", "--data", str(folders / "data"), *store]
    assert main(load, spark) == 0
    assert capsys.readouterr().out.splitlines() == [f"{t.name}\t1 rows inserted" for t in LOAD_ORDER]
    assert main(load, spark) == 0
    assert capsys.readouterr().out.splitlines() == [f"{t.name}\t0 rows inserted" for t in LOAD_ORDER]
    assert main(["build", *store], spark) == 0
    assert "fct_orders\t1 rows" in capsys.readouterr().out
    assert main(["test", *store], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 31 and all(line.endswith("PASS") for line in lines)
    assert main(["audit", *store], spark) == 0
    out = str(folders / "trend")
    assert main(["report", "monthly_revenue_trend", "--out", out, *store], spark) == 0
    row = spark.read.parquet(out).first()
    assert (row["month"], str(row["monthly_revenue"]), row["trend"]) == ("2017-10", "38.71", "first month")


def test_registered_tables_and_location_reports(spark, folders, capsys):
    store = ["--store", str(folders / "named")]
    assert main(["load", "--data", str(folders / "data"), *store], spark) == 0
    assert main(["build", "--database", "shop", *store], spark) == 0
    assert main(["build", "--database", "shop", *store], spark) == 0
    assert spark.table("shop.fct_orders").count() == spark.table("shop.orders").count() == 1
    assert spark.catalog.getTable("shop.payments").description == TABLES["payments"].comment
    capsys.readouterr()
    assert main(["report", "geo_customers", *store], spark) == 0
    assert capsys.readouterr().out.splitlines()[1].endswith("-23.500000\t-46.600000")


def test_files_of_a_table_as_they_arrive(spark, folders, capsys):
    store = ["--store", str(folders / "streamed")]
    assert main(["load", "--data", str(folders / "data"), *store], spark) == 0
    (folders / "arriving").mkdir()
    header = ",".join(TABLES["payments"].columns)
    (folders / "arriving" / "one.csv").write_text(f"{header}\no1,1,voucher,1,5.00\no1,2,voucher,1,5.00\no9,1,voucher,1,5.00\n")
    stream = ["stream", "--table", "payments", "--data", str(folders / "arriving"), "--progress", str(folders / "seen")]
    capsys.readouterr()
    assert main([*stream, *store], spark) == 0
    assert capsys.readouterr().out.splitlines()[-1] == "payments\t2 rows stored"
