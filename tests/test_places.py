from __future__ import annotations

import math
import random

import pytest

from helpers import tuples
from mercato.plans.extensions import EARTH, cohorts, first_purchases, nearest_places


def metres(a, b):
    (la, na), (lb, nb) = ([math.radians(float(v)) for v in p] for p in (a, b))
    half = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((nb - na) / 2) ** 2
    return round(2 * EARTH * math.asin(math.sqrt(min(half, 1.0))))


def places(spark, rows):
    schema = "zip_code string, lat decimal(9,6), lng decimal(9,6)"
    from decimal import Decimal

    return spark.createDataFrame([(z, Decimal(str(a)), Decimal(str(b))) for z, a, b in rows], schema)


def scattered(seed, n, near):
    rng = random.Random(seed)
    spread = (lambda lo, hi: rng.uniform(lo, hi)) if not near else (lambda lo, hi: rng.gauss(0, 1.5))
    return [(f"{seed}-{k:04}", round(spread(-90, 90), 4), round(spread(-180, 180), 4)) for k in range(n)]


EDGES = [("pole", 90, 0), ("pole too", 90, 135), ("south", -90, 7), ("west", 10, -180), ("east", 10, 180), ("zero", 0, 0)]


@pytest.mark.parametrize("near", [True, False])
@pytest.mark.parametrize("cell", [0.25, 20])
def test_nearest_of_all(spark, near, cell):
    of, among = scattered(1, 120, near) + EDGES, scattered(2, 60, near) + EDGES[1:2] + EDGES[4:]
    of += [("twin", 5, 5)]
    among += [("b", 5.5, 5), ("a", 4.5, 5)]
    expected = {z: min((metres((a, b), (c, d)), other) for other, c, d in among) for z, a, b in of}
    found = nearest_places(places(spark, of), places(spark, among), cell)
    assert {z: (m, other) for z, other, m in tuples(found.select("zip_code", "nearest_zip", "metres"))} == expected
    assert found.count() == len(of)


def test_nothing_to_find(spark):
    some, none = places(spark, EDGES), places(spark, [])
    assert nearest_places(none, some).count() == 0
    assert nearest_places(some, none, 60).count() == 0


def test_the_state_of_cohorts_can_be_carried_on(spark, lake):
    tables = {name: lake[name] for name in ("orders", "customers", "geolocation")}
    whole = sorted(tuples(first_purchases(tables)))
    assert len(whole) == len({person for person, _ in whole})
    for cut in ("1993-06-01", "1996-01-01"):
        parts = [tables["orders"].where(f"order_purchase_timestamp {sign} '{cut}'") for sign in (">=", "<")]
        for first, second in (parts, parts[::-1]):
            state = first_purchases({**tables, "orders": first})
            assert sorted(tuples(first_purchases({**tables, "orders": second}, state))) == whole
    matrix = cohorts(tables).collect()
    starts = {r["cohort_month"]: r for r in matrix if r["months_since"] == 0}
    assert all(float(r["pct_of_cohort"]) == 100 for r in starts.values())
    assert sum(r["shoppers"] for r in starts.values()) == len(whole)
    assert min(r["months_since"] for r in matrix) == 0
