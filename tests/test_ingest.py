from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from helpers import column, raw_text, scratch, shuffled, tuples, typed
from mercato.operators.keys import arrival_columns
from mercato.operators.upsert import insert_if_absent
from mercato.plans.clean import rejects
from mercato.plans.ingest import BATCH, BATCH_AND_STORED, ingest, ingest_folder, load, reset
from mercato.schemas import LOAD_ORDER, TABLES
from mercato.session import Stages
from mercato.sources import sample
from mercato.sources.csv import read_csv
from mercato.sources.store import DerivedStore, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def people(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, town string")


def test_insert_if_absent(spark, store):
    first = people(spark, ("a", "x"), ("b", "y"))
    assert insert_if_absent(first, store, "people", ["id"]) == 2
    assert insert_if_absent(first, store, "people", ["id"]) == 0
    # A known key keeps its stored value.
    assert insert_if_absent(people(spark, ("b", "changed"), ("c", "z")), store, "people", ["id"]) == 1
    assert insert_if_absent(people(spark), store, "people", ["id"]) == 0
    assert sorted(tuples(store["people"])) == [("a", "x"), ("b", "y"), ("c", "z")]


def test_a_second_unique_key_is_kept_too(spark, store):
    reviews = "review_id string, order_id string"
    first = spark.createDataFrame([("r1", "o1")], reviews)
    later = spark.createDataFrame([("r2", "o1"), ("r3", "o2")], reviews)
    for batch, want in ((first, 1), (later, 1)):
        assert insert_if_absent(batch, store, "order_reviews", ["review_id"], [["order_id"]]) == want
    assert sorted(column(store["order_reviews"], "review_id")) == ["r1", "r3"]


def test_a_new_session_object_finds_the_stored_tables(spark, store):
    insert_if_absent(people(spark, ("a", "x")), store, "people", ["id"])
    again = Store(spark, store.root)
    assert "people" in again and "others" not in again
    assert insert_if_absent(people(spark, ("a", "x"), ("b", "y")), again, "people", ["id"]) == 1
    with pytest.raises(KeyError):
        again["others"]


def test_a_derived_table_is_built_once(spark, tmp_path):
    built = []

    def build(tables):
        built.append(1)
        return tables["base"].where("id > 2")

    derived = DerivedStore(spark, str(tmp_path), {"base": lambda _: spark.range(5), "big": build})
    assert derived["big"].count() == derived["big"].count() == 2
    assert built == [1]


def test_reset(spark, store):
    insert_if_absent(people(spark, ("a", "x")), store, "orders", ["id"])
    reset(store)
    assert "orders" not in store and "orders" not in Store(spark, store.root)


def test_a_failing_parent_fails_its_children(spark, raw, tmp_path):
    broken = {**raw, "customers": raw["customers"].drop("customer_id")}
    with pytest.raises(Exception, match="customer_id"):
        load(broken, Store(spark, str(tmp_path / "store")))


def batch(spark, orders, payments):
    none = {t.name: raw_text(spark, t.name, []) for t in LOAD_ORDER}
    customers = [{"customer_id": c, "customer_unique_id": c} for _, c in orders]
    none["customers"] = raw_text(spark, "customers", customers)
    names = ("order_id", "customer_id")
    none["orders"] = raw_text(spark, "orders", [{**dict(zip(names, o)), "order_status": "shipped"} for o in orders])
    none["payments"] = raw_text(
        spark,
        "payments",
        [
            {
                "order_id": o,
                "payment_sequential": n,
                "payment_type": "boleto",
                "payment_installments": "1",
                "payment_value": v,
            }
            for o, n, v in payments
        ],
    )
    return none


@pytest.mark.parametrize(("parents", "want"), [(BATCH, 0), (BATCH_AND_STORED, 1)])
def test_children_of_stored_parents(spark, store, parents, want):
    ingest(batch(spark, [("o1", "c1")], [("o1", "1", "5")]), store, parents)
    later = ingest(batch(spark, [("o2", "c2")], [("o1", "2", "5"), ("o1", "1", "9")]), store, parents)
    assert later["payments"] == want
    assert later["orders"] == later["customers"] == 1
    assert store["payments"].count() == 1 + want


def test_unknown_parent_mode(store):
    with pytest.raises(ValueError):
        ingest({}, store, "all")


def test_loading_twice_is_loading_once(raw, store):
    first = ingest(raw, store)
    again = ingest(raw, store)
    assert set(again.values()) == {0}
    assert {name: store[name].count() for name in first} == first
    assert first["order_items"] == 3_021


def test_loading_a_folder_of_csv_files(spark, raw, tmp_path, lake):
    from pyspark.sql import functions as F

    for table in LOAD_ORDER:
        rows = raw[table.name].select(
            *[
                F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kind == "timestamp" else F.col(c)
                for c, kind in raw[table.name].select(*table.columns).dtypes
            ]
        )
        named = rows.toDF(*table.columns).coalesce(1)
        file = table.file.replace("*", "shop_").replace("__", "_")
        named.write.option("header", True).option("escape", '"').csv(str(tmp_path / "data" / file))
    gained = ingest_folder(spark, str(tmp_path / "data"), str(tmp_path / "store"))
    # Amounts above the declared ten digits do not occur here; the rest is as from typed tables,
    # except that "first" is file order there and so may pick another copy of a payment or line.
    for name in ("geolocation", "customers", "sellers", "products", "orders", "order_reviews"):
        assert gained[name] == lake[name].count(), name
    stored = Store(spark, str(tmp_path / "store"))
    assert dict(stored["orders"].dtypes)["order_purchase_timestamp"] == "timestamp"
    assert dict(stored["payments"].dtypes)["payment_value"] == "decimal(10,2)"
    assert typed(spark, "sellers", []).dtypes == stored["sellers"].dtypes


def test_a_folder_left_by_a_failed_write_is_no_table(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(Exception):
        store.append(spark.range(3).where("assert_true(id < 0) is null"), "t")
    assert (tmp_path / "store" / "t").exists()
    again = Store(spark, str(tmp_path / "store"))
    assert "t" not in again
    again.append(spark.range(3), "t")
    assert Store(spark, str(tmp_path / "store"))["t"].count() == 3


def test_losses_are_counted_during_the_load(spark, raw, lake, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    loaded = load(raw, store)
    exact = {tuple(r) for t in LOAD_ORDER for r in rejects(t.name, raw[t.name], lake).collect()}
    assert set(loaded.losses) == exact and len(loaded.losses) == len(exact)
    again = load(raw, store)
    assert set(again.losses) == exact and not any(again.inserted.values())
    assert sorted(tuples(loaded.report(spark)), key=repr) == sorted(exact, key=repr)


def test_losses_where_nothing_is_left(spark, raw, tmp_path):
    none = {name: df.limit(0) for name, df in raw.items()} | {"payments": raw["payments"]}
    loaded = load(none, Store(spark, str(tmp_path / "store")))
    rows = {rule: (left, dropped) for table, _, rule, left, dropped in loaded.losses if table == "payments"}
    assert rows["input"][0] == raw["payments"].count() and rows["unknown order_id"][0] == 0
    assert rows["unknown order_id"][1] > 0 and sum(loaded.inserted.values()) == 0


def test_a_load_leaves_neither_shuffled_files_nor_scratch_tables(spark, raw, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    before, kept = shuffled(spark), scratch(spark)
    for _ in range(2):
        load(raw, store)
    for _ in range(50):
        if not shuffled(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffled(spark) - before
    # Keys of a batch are read by the tables that refer to them.
    assert {name.split("-")[0] for name in scratch(spark) - kept} <= {f"batch_{t.name}" for t in LOAD_ORDER}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_packed_files_keep_the_order_of_arrival(spark, raw, tmp_path, monkeypatch):
    monkeypatch.setattr(sample, "FILE_ROWS", 100)
    folder = tmp_path / "messy"
    sample.write_messy_csv(raw, str(folder))
    table = TABLES["order_items"]
    path = folder / "shop_order_items_dataset.csv"
    assert len(list(path.glob("*.csv.gz"))) > 10
    rows = read_csv(spark, str(path), table)
    keys = ["order_id", "product_id", "shipping_limit_date"]
    got = tuples(rows.orderBy(*arrival_columns(rows)).select(*keys))
    texts = [F.col(c).cast("string") for c in keys[:2]] + [F.date_format(keys[2], "yyyy-MM-dd HH:mm:ss")]
    expected = raw["order_items"].orderBy(*arrival_columns(raw["order_items"])).select(*texts)
    assert got == tuples(expected)


def test_rows_are_staged_before_they_are_shuffled_anew(spark, raw, tmp_path, monkeypatch):
    plain = Store(spark, str(tmp_path / "plain"))
    expected, kept, names = load(raw, plain), scratch(spark), []

    def noted(self, df, whole=Stages.__call__):
        names.append(self.name)
        return whole(self, df)

    monkeypatch.setattr(Stages, "__call__", noted)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = Store(spark, str(tmp_path / "staged"))
        found = load(raw, store)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found == expected
    assert {name: names.count(name) for name in names} == {"cleaned_orders": 1, "cleaned_order_items": 3}
    assert not scratch(spark) - kept
    for table in LOAD_ORDER:
        assert sorted(tuples(store[table.name]), key=repr) == sorted(tuples(plain[table.name]), key=repr)


def test_rows_that_are_all_new_are_not_looked_up_again(spark, store, monkeypatch):
    first = people(spark, ("a", "x"))
    insert_if_absent(first, store, "people", ["id"])
    kinds = []

    def noted(self, other, on=None, how=None, whole=type(first).join):
        kinds.append(how)
        return whole(self, other, on, how)

    monkeypatch.setattr(type(first), "join", noted)
    assert insert_if_absent(people(spark, ("b", "y"), ("c", "z")), store, "people", ["id"]) == 2
    assert "left_semi" not in kinds
    assert insert_if_absent(people(spark, ("c", "other"), ("d", "z")), store, "people", ["id"]) == 1
    assert kinds.count("left_semi") == 1
    assert sorted(tuples(store["people"])) == [("a", "x"), ("b", "y"), ("c", "z"), ("d", "z")]
