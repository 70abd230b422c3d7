"""Every registered query against its DuckDB twin on the same files."""

import re

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
#: Queries over the text operators have tests of their own.
TEXT = re.compile(r"op\d+_|pipeline$")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    yield con
    con.close()


def in_name_order(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([row[i] for i in at]) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_oracle(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert in_name_order(got.columns, [tuple(r) for r in got.collect()]) == in_name_order(
        names, want.fetchall()
    )


def test_every_query_has_an_oracle():
    assert {q for q in QUERIES if not TEXT.match(q)} <= set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() == 1
