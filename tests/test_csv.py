from __future__ import annotations

import pytest

from helpers import column, tuples, typed
from mercato.operators.keys import arrival_columns, keep_first
from mercato.plans.clean import clean, rejects
from mercato.schemas import CATEGORY_TRANSLATION, CUSTOMERS, LOAD_ORDER, ORDER_REVIEWS, SELLERS
from mercato.sources.csv import read_csv, read_csv_folder


def write(path, text, mark=b""):
    path.write_bytes(mark + text.encode())
    return str(path)


def test_review_texts_with_line_breaks_and_quotes(spark, tmp_path):
    path = write(
        tmp_path / "r.csv",
        "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,"
        'review_answer_timestamp\r\n"r1","o1",5,NA,"two\nlines, and ""quotes""",2018-01-18,\r\n'
        '"r2","o2",1,,plain,2018-01-18,2018-01-19\r\n',
    )
    got = read_csv(spark, path, ORDER_REVIEWS).select(*ORDER_REVIEWS.columns)
    assert sorted(tuples(got)) == [
        ("r1", "o1", "5", None, 'two\nlines, and "quotes"', "2018-01-18", None),
        ("r2", "o2", "1", None, "plain", "2018-01-18", "2018-01-19"),
    ]


def test_byte_order_mark(spark, tmp_path):
    text = "product_category_name,product_category_name_english\r\nbebes,baby\r\n"
    path = write(tmp_path / "t.csv", text, b"\xef\xbb\xbf")
    got = read_csv(spark, path, CATEGORY_TRANSLATION).select(*CATEGORY_TRANSLATION.columns)
    assert tuples(got) == [("bebes", "baby")]


def test_columns_go_by_name_and_zeros_stay(spark, tmp_path):
    path = write(
        tmp_path / "s.csv", "seller_state,extra,seller_id,seller_city,seller_zip_code_prefix\nSP,x,s1,null,01037\n"
    )
    got = read_csv(spark, path, SELLERS).select(*SELLERS.columns)
    assert tuples(got) == [("s1", "01037", None, "SP")]


def test_first_means_first_in_the_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    header = "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
    for n in range(3):
        rows = "".join(f"c{k},u{n}-{k},1,city,SP\n" for k in [*range(50), *range(50)])
        write(folder / f"part{n}.csv", header + rows)
    raw = read_csv(spark, str(folder), CUSTOMERS)
    assert len(arrival_columns(raw)) == 3
    first = keep_first(raw.repartition(5), ["customer_id"])
    assert sorted(column(first, "customer_unique_id")) == sorted(f"u0-{k}" for k in range(50))


def test_a_folder_of_files(spark, tmp_path):
    for table in LOAD_ORDER:
        name = table.file.replace("*", "shop_").replace("__", "_")
        write(tmp_path / name, ",".join(table.columns) + "\n" + ",".join("1" for _ in table.columns) + "\n")
    raw = read_csv_folder(spark, str(tmp_path))
    assert [df.count() for df in raw.values()] == [1] * 9
    assert "shop_orders_dataset.csv" in raw["orders"].inputFiles()[0]


def test_files_with_columns_in_another_order_are_refused(spark, tmp_path):
    from mercato.schemas import TABLES

    table = TABLES["product_category_name_translation"]
    first, second = table.columns
    (tmp_path / "a.csv").write_text(f"{first},{second}\nx,y\n")
    (tmp_path / "b.csv").write_text(f"{second},{first}\ny2,x2\n")
    with pytest.raises(Exception, match="CSV header"):
        read_csv(spark, str(tmp_path / "*.csv"), table).collect()
    swapped = read_csv(spark, str(tmp_path / "b.csv"), table).select(first, second).collect()
    assert [tuple(r) for r in swapped] == [("x2", "y2")]


def test_rows_that_cannot_be_parsed_are_marked_and_counted(spark, tmp_path):
    lines = [
        ",".join(CUSTOMERS.columns),
        "1,n1,00001,c1,SP",
        "2",
        '3,"n3,00003,c3,SP',
        "4,n4,00004,c4,SP" + ",x" * 7,
        '5,"a ""b"", c",00005,c5,SP',
        "6,n6,00006,c6,SP",
        "6,again,00006,c6,SP",
    ]
    (tmp_path / "customers.csv").write_text("\n".join(lines) + "\n")
    raw = read_csv(spark, str(tmp_path / "customers.csv"), CUSTOMERS)
    marks = {r["customer_id"]: r["_unreadable"] for r in raw.collect() if r["customer_unique_id"] != "again"}
    assert marks == {"1": False, "2": True, "3": True, "4": True, "5": False, "6": False}
    dropped = {r["rule"]: r["rows_dropped"] for r in rejects("customers", raw, {}).collect()}
    assert dropped["unreadable row"] == 3 and dropped["repeated customer"] == 1
    places = typed(spark, "geolocation", [])
    got = clean("customers", raw, {"geolocation": places}).select("customer_id", "customer_unique_id")
    assert sorted(tuples(got)) == [("1", "n1"), ("5", 'a "b", c'), ("6", "n6")]


def test_a_quote_left_open_in_a_file_with_line_breaks(spark, tmp_path):
    header = ",".join(ORDER_REVIEWS.columns)
    rest = ",2018-01-01,2018-01-02"
    lines = [header, 'r1,o1,5,t,"two\nlines"' + rest, 'r2,o2,5,"t,open' + rest, "r3,o3,5,t,m" + rest]
    (tmp_path / "reviews.csv").write_text("\n".join(lines) + "\n")
    raw = read_csv(spark, str(tmp_path / "reviews.csv"), ORDER_REVIEWS)
    assert [(r["review_id"], r["_unreadable"]) for r in raw.collect()] == [("r1", False), ("r2", True)]
