from __future__ import annotations

from collections import Counter

import pytest

from helpers import column, tuples, typed
from mercato.operators.deletes import RestrictedDelete, propagate_deletes
from mercato.plans import quality
from mercato.schemas import LOAD_ORDER


def test_failing_rows(spark):
    df = spark.createDataFrame(
        [(1, "a", 1), (1, "b", 2), (2, "z", None), (None, None, 9), (None, "a", 1)], "k int, v string, p int"
    )
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    assert tuples(quality.failing_unique(df, ["k"])) == [(1, 2)]
    assert quality.failing_not_null(df, "k").count() == 2
    assert tuples(quality.failing_accepted_values(df, "v", ["a", "b"])) == [("z", 1)]
    assert column(quality.failing_relationships(df, "p", parents, "id"), "p") == [9]


def test_there_are_31_tests_and_the_models_pass_them(lake):
    report = quality.quality_report(lake, lake).collect()
    assert Counter(r["test"] for r in report) == {
        "unique": 10,
        "not_null": 18,
        "accepted_values": 2,
        "relationships": 1,
    }
    assert {r["status"] for r in report} == {"PASS"}


def broken(spark):
    """Tables that break rules on purpose; a null breaks only not-null rules."""
    tables = {t.name: typed(spark, t.name, []) for t in LOAD_ORDER}
    tables["orders"] = typed(
        spark,
        "orders",
        [
            {"order_id": "o1", "customer_id": "gone", "order_status": "lost"},
            {"order_id": "o1", "customer_id": "c1", "order_status": "odd"},
            {"order_id": None, "customer_id": None, "order_status": None},
        ],
    )
    tables["customers"] = typed(spark, "customers", [{"customer_id": "c1", "customer_unique_id": "u"}])
    tables["order_reviews"] = typed(
        spark,
        "order_reviews",
        [
            {"review_id": "r1", "order_id": "o1", "review_score": 0},
            {"review_id": "r2", "order_id": "o1", "review_score": None},
        ],
    )
    tables["products"] = typed(
        spark,
        "products",
        [
            {"product_id": "p", "product_weight_g": "-1", "product_photos_qty": "-1"},
            {"product_id": "q", "product_weight_g": None},
        ],
    )
    return tables


def test_report_on_broken_models(spark):
    failed = quality.quality_report(broken(spark)).where("status = 'FAIL'").drop("status")
    # The row without an id does not pass staging.
    by_test = {(m, c, t): n for m, c, t, n in tuples(failed)}
    assert by_test[("stg_orders", "order_id", "unique")] == 1
    assert by_test[("stg_orders", "order_status", "accepted_values")] == 2
    assert by_test[("stg_order_reviews", "review_score", "accepted_values")] == 1
    # Two reviews of the order double its rows in the fact.
    assert by_test[("fct_orders", "customer_id", "relationships")] == 2
    assert len(by_test) == 5


def test_audits(spark):
    tables = broken(spark)

    def violations(report):
        return {tuple(row[:-1]): row[-1] for row in tuples(report) if row[-1]}

    assert quality.audit_keys(tables).count() == 10
    assert violations(quality.audit_keys(tables)) == {
        ("orders", "primary key", "order_id"): 1,
        ("order_reviews", "unique", "order_id"): 1,
    }
    assert quality.audit_foreign_keys(tables).count() == 9
    assert violations(quality.audit_foreign_keys(tables)) == {("orders", "customer_id", "customers"): 1}
    assert quality.audit_checks(tables).count() == 14
    assert violations(quality.audit_checks(tables)) == {
        ("orders", "status_known"): 2,
        ("order_reviews", "score_in_range"): 1,
        ("products", "weight_positive"): 1,
        ("products", "photos_not_negative"): 1,
    }
    assert violations(quality.audit_not_null(tables)) == {
        ("orders", "order_id"): 1,
        ("orders", "customer_id"): 1,
        ("orders", "order_status"): 1,
        ("order_reviews", "review_score"): 1,
    }


def test_clean_tables_hold_every_key_and_not_null_rule(lake):
    for audit in (quality.audit_keys, quality.audit_foreign_keys, quality.audit_checks, quality.audit_not_null):
        assert {row["violations"] for row in audit(lake).collect()} == {0}


def family(spark):
    tables = {t.name: typed(spark, t.name, []) for t in LOAD_ORDER}
    zips = [{"geolocation_zip_code_prefix": z} for z in ("00001", "00002")]
    tables["geolocation"] = typed(spark, "geolocation", zips)
    people = [("c1", "00001"), ("c2", "00002"), ("c3", None)]
    tables["customers"] = typed(
        spark, "customers", [{"customer_id": c, "customer_zip_code_prefix": z} for c, z in people]
    )
    tables["orders"] = typed(spark, "orders", [{"order_id": f"o{n}", "customer_id": f"c{n}"} for n in (1, 2)])
    lines = [("o1", 1), ("o1", 2), ("o2", 1)]
    tables["order_items"] = typed(
        spark, "order_items", [{"order_id": o, "order_item_id": n, "product_id": "p"} for o, n in lines]
    )
    tables["products"] = typed(spark, "products", [{"product_id": p} for p in ("p", "q")])
    return tables


def keys(spark, name, *values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_deleting_a_place_clears_references(spark):
    changed = propagate_deletes(family(spark), "geolocation", keys(spark, "geolocation_zip_code_prefix", "00001"))
    assert sorted(changed) == ["customers", "geolocation", "sellers"]
    got = changed["customers"].select("customer_id", "customer_zip_code_prefix")
    assert sorted(tuples(got)) == [("c1", None), ("c2", "00002"), ("c3", None)]
    assert column(changed["geolocation"]) == ["00002"]


def test_deleting_an_order_takes_its_children(spark):
    changed = propagate_deletes(family(spark), "orders", keys(spark, "order_id", "o1"))
    assert column(changed["orders"]) == ["o2"]
    assert tuples(changed["order_items"].select("order_id", "order_item_id")) == [("o2", 1)]
    assert "customers" not in changed


def test_deleting_what_is_referenced_is_refused(spark):
    tables = family(spark)
    with pytest.raises(RestrictedDelete, match="order_items"):
        propagate_deletes(tables, "products", keys(spark, "product_id", "p"))
    assert column(propagate_deletes(tables, "products", keys(spark, "product_id", "q"))["products"]) == ["p"]
    with pytest.raises(RestrictedDelete, match="orders"):
        propagate_deletes(tables, "customers", keys(spark, "customer_id", "c1"))
    assert propagate_deletes(tables, "customers", keys(spark, "customer_id", "c3"))["customers"].count() == 2
