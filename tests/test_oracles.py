"""Each query against its SQL in DuckDB, and what the cleaner's queries find."""

import duckdb
import pytest

import __spark_entry__ as entry
from leafmill.plans import queries as Q
from leafmill.plans.oracles import PREDICATES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def table(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(([value(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf, con, name):
    df = Q.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    assert rows, "a query that finds nothing proves nothing"
    if name in Q.ORACLES:
        want = con.sql(Q.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert table(rows, df.columns) == table(want.fetchall(), want.columns)


def test_not_vacuous(spark, sf):
    """Every reason to remove a line is met, and so are lines that stay."""
    found = {r.reason: r.lines for r in Q.QUERIES["drop_reason_counts"](spark, sf).collect()}
    assert set(PREDICATES) | {"repeated", "custom", "kept"} <= set(found) and all(found.values())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["reason", "lines"] and df.count() > 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_shuffle(spark, sf):
    """Cleaning plans no exchange: a document stays where it was read."""
    from leafmill.operators.clean import clean_text

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = clean_text(docs).select("doc_id", "cleaned_text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_all_pages(spark, sf):
    """Every turn of every conversation goes through JSON."""
    want = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text")
    got = Q.QUERIES["page_json"](spark, sf)
    assert want.where("turn > 2").count() and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
