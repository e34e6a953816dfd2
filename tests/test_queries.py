"""Every registered query against its SQL over the same tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from strikeline import fixed
from strikeline.oracles import ORACLES
from strikeline.queries import REGISTRY

#: Small, but large enough for every query to have rows.
DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    fixed = [
        tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order)
        for r in rows
    ]
    return sorted(fixed, key=str)


def test_registered_names():
    assert set(REGISTRY) == set(ORACLES)
    assert set(REGISTRY) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = contract.queries()[name](spark, DATA)
    result = duck.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(got.columns)
    want = _sorted(result.fetchall(), columns)
    assert want, "a query without rows tests nothing"
    assert _sorted([tuple(r) for r in got.collect()], got.columns) == want


@pytest.mark.parametrize(("name", "column", "values"), [
    ("dq_verdict", "passed", {True, False}),
    ("entry_decisions", "can_enter", {True, False}),
    ("strike_lookup", "strike_ok", {True, False}),
    ("close_rules", "closed", {True, False}),
    ("close_rules", "TA_SIGNAL", set(fixed.TRADABLE) | set(fixed.EXIT_ONLY)),
    ("config_key_touched", "ke", {"MAIN", "SPARE"}),
    ("trade_lifecycle", "TRADE_STATUS", {"OPEN", "CLOSE"}),
    ("market_open", "market_is_open", {"YES", "NO"}),
])
def test_both_outcomes_occur(spark, name, column, values):
    got = {r[0] for r in REGISTRY[name](spark, DATA).select(column).distinct().collect()}
    assert values <= got


def test_entry(spark):
    assert contract.entry(spark).count() == 1000
