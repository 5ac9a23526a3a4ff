"""The driver's contract: every query runs, and those with SQL agree with it."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The queries of this library's own; those of the llm subpackage have their tests beside it.
OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(str(round(r[i], 9)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in entry.oracle_sql():
        want = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert plain([tuple(r) for r in rows], df.columns) == plain(want.fetchall(), names)


@pytest.mark.parametrize("name", [n for n in OWN if "changed" in entry.oracle_sql().get(n, "") and n not in ("x",)])
def test_text_rules_fire(spark, name):
    assert entry.queries()[name](spark, SF).where("changed").count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 20
