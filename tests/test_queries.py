"""Every query of the library against its SQL, over the whole small tables."""

import math

import duckdb
import pytest

from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


#: Queries that have no rows on the smallest tables.
LARGER = "c8_holding_map x3_profile x_breakout_trades x_sweep_trades x_summary x4_excursions x2_stop_target_grid j9_common_calendar a18_profiles".split()


@pytest.fixture(scope="module")
def connect():
    made = {}

    def connect(sf):
        if sf not in made:
            made[sf] = con = duckdb.connect()
            for t in TABLES:
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        return made[sf]

    return connect


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else x
        return x

    return sorted(([value(r[k]) for k in order] for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, sf, connect, name):
    sf = "/root/testdata/sf0.01" if name in LARGER else sf
    con = connect(sf)
    df = registry.queries()[name](spark, sf)
    rel = con.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    found, expected = plain([tuple(r) for r in df.collect()], df.columns), plain(rel.fetchall(), names)
    assert len(found) == len(expected) > 0
    for a, b in zip(found, expected, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (x is not None and y is not None and not isinstance(x, str) and abs(float(x) - float(y)) <= 1.01e-6), (name, a, b)


#: Queries without SQL, and the test that compares each with brute force.
ELSEWHERE = {"c8_delay_curve": "test_positions.py", "x_exit_sweep": "test_positions.py", "x_tournament": "test_positions.py", "m4_classifier": "test_learning.py", "m6_penalty_choice": "test_learning.py", "m7_sealed_score": "test_learning.py", "i2_permutation": "test_replicas.py", "i3_date_vectors": "test_replicas.py", "i8_block_permuted_ic": "test_replicas.py",
             "i9_rule_discovery": "test_discovery.py", "i14_pair_null": "test_research.py", "i19_strategy_search": "test_research.py", "i19_volume_gate": "test_research.py", "st5_positions": "test_streams.py"}


def test_queries_without_sql_are_tested_elsewhere():
    assert set(registry.queries()) - set(SQL) <= set(ELSEWHERE)
