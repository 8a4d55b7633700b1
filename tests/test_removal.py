from __future__ import annotations

import pytest

from helpers import tuples, typed
from mercato.operators.deletes import RestrictedDelete
from mercato.operators.upsert import insert_if_absent
from mercato.plans import removal
from mercato.plans.removal import delete_rows, finish_deletes
from mercato.schemas import LOAD_ORDER
from mercato.sources.store import Store

ROWS = {
    "geolocation": [
        {"geolocation_zip_code_prefix": z, "geolocation_lat": "1", "geolocation_lng": "1", "geolocation_city": "c", "geolocation_state": "s"}
        for z in ("00001", "00002")
    ],
    "customers": [
        {"customer_id": f"c{n}", "customer_unique_id": f"p{n}", "customer_zip_code_prefix": f"0000{n % 3}"} for n in range(6)
    ],
    "orders": [{"order_id": f"o{n}", "customer_id": f"c{n}", "order_status": "shipped"} for n in range(4)],
    "payments": [
        {"order_id": f"o{n}", "payment_sequential": k, "payment_type": "boleto", "payment_installments": "1", "payment_value": "5"}
        for n in range(4)
        for k in (1, 2)
    ],
    "order_reviews": [{"review_id": f"r{n}", "order_id": f"o{n}", "review_score": "5"} for n in range(4)],
}


@pytest.fixture
def store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), key_buckets=2)
    for t in LOAD_ORDER:
        # One file for each first key.
        store.append(typed(spark, t.name, ROWS.get(t.name, [])).repartitionByRange(6, t.key[0]), t.name)
    return store


def content(store):
    return {t.name: sorted(tuples(store[t.name]), key=repr) for t in LOAD_ORDER}


def keys(spark, name, *values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_only_files_with_rows_that_change_are_written(spark, store):
    before, files = content(store), {t.name: store.files(t.name) for t in LOAD_ORDER}
    touched = delete_rows(store, "orders", keys(spark, "order_id", "o2", "none"))
    assert touched == {"orders": 1, "payments": 1, "order_reviews": 1}
    want = {name: [r for r in rows if name not in touched or "o2" not in r] for name, rows in before.items()}
    assert content(store) == want and content(Store(spark, store.root)) == want
    for t in LOAD_ORDER:
        kept = files[t.name] & store.files(t.name)
        assert len(kept) == len(files[t.name]) - touched.get(t.name, 0)


def test_references_are_emptied_or_forbid(spark, store):
    delete_rows(store, "geolocation", keys(spark, "geolocation_zip_code_prefix", "00001"))
    zips = {r["customer_id"]: r["customer_zip_code_prefix"] for r in store["customers"].collect()}
    assert zips == {f"c{n}": None if n % 3 == 1 else f"0000{n % 3}" for n in range(6)}
    before = content(store)
    with pytest.raises(RestrictedDelete):
        delete_rows(store, "customers", keys(spark, "customer_id", "c1", "c5"))
    assert content(store) == before
    assert delete_rows(store, "customers", keys(spark, "customer_id", "c5")) == {"customers": 1}
    assert delete_rows(store, "customers", keys(spark, "customer_id", "c5")) == {}


@pytest.mark.parametrize("steps", range(5))
def test_a_delete_that_was_broken_off_is_finished(spark, store, monkeypatch, steps):
    whole, done = removal._replace, []

    def broken(*arguments):
        if len(done) == steps:
            raise RuntimeError("lost")
        done.append(whole(*arguments))

    before = content(store)
    monkeypatch.setattr(removal, "_replace", broken)
    if steps < 3:
        with pytest.raises(RuntimeError):
            delete_rows(store, "orders", keys(spark, "order_id", "o1"))
    else:
        delete_rows(store, "orders", keys(spark, "order_id", "o1"))
    monkeypatch.setattr(removal, "_replace", whole)
    again = Store(spark, store.root, key_buckets=2)
    finish_deletes(again)
    assert content(again) == {
        name: [r for r in rows if name == "customers" or "o1" not in r] for name, rows in before.items()
    }


def test_one_that_never_reached_its_journal_changes_nothing(spark, store, monkeypatch):
    before, gone = content(store), keys(spark, "order_id", "o1")
    monkeypatch.setattr(removal, "_JOURNAL", "no such folder/journal.json\0")
    with pytest.raises(Exception):
        delete_rows(store, "orders", gone)
    monkeypatch.undo()
    assert content(store) == before
    finish_deletes(store)
    assert content(store) == before


def test_a_deleted_key_can_come_again(spark, store):
    order = store["orders"].where("order_id = 'o3'")
    row = spark.createDataFrame(order.collect(), order.schema)
    assert insert_if_absent(row, store, "orders", ["order_id"]) == 0
    delete_rows(store, "orders", keys(spark, "order_id", "o3"))
    assert insert_if_absent(row, store, "orders", ["order_id"]) == 1
