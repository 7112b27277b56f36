"""The queries that have SQL against DuckDB, on the given tables and on one with nulls, repeated ids and odd texts."""

import random

import duckdb
import pytest

from tarn.llm import queries

TABLES = "documents conversations".split()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null and repeated ids and hosts, empty, short and long texts, copies, near copies, lines of many documents."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijäöß") for _ in range(r.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows, footers = [], ["Copyright 2019 of  the makers", "COPYRIGHT 7 OF THE\tMAKERS "]
    for k in range(60):
        body = text(r.choice([1, 2, 3, 19, 20, 40, 90]))
        rows.append((len(rows), f"{body}\n{footers[k % 2]}", f"s{k % 2}" if k % 5 else None))
        if k % 4 == 0:
            at = body.split(" ")
            at[len(at) // 2] = "changed"
            rows.append((len(rows), " ".join(at), "s0"))
        if k % 6 == 0:
            rows.append((len(rows), rows[-1][1], "s1"))
    rows += [(None, None, None), (None, text(30), "s0"), (3, text(30), "s1"), (3, text(30), "s1"), (-5, "", "s0"), (2**62, " \n\t ", "s0")]
    rows += [(len(rows), t, "s1") for t in ["one two", "ONE  two", "😀 ü " * 15, "a b c d e f g h " * 9, "<|>#$%&* " * 30, text(20000), "same line here\n" * 12]]
    rows += [rows[5]] * 3
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(path / "documents.parquet"))
    return str(path)


def equal(spark, name, sf_dir, files):
    con = duckdb.connect()
    for table in TABLES:
        if table in files:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{files[table]}'")
    oracle = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(oracle.columns) == sorted(df.columns)
    places = [oracle.columns.index(c) for c in df.columns]
    assert sorted(repr(tuple(x)) for x in df.collect()) == sorted(repr(tuple(x[k] for k in places)) for x in oracle.fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_given_tables(spark, name):
    where = "/root/testdata/sf0.001"
    equal(spark, name, where, {table: f"{where}/{table}.parquet" for table in TABLES})


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - {"op8_preference"}))
def test_odd_documents(spark, odd, name):
    equal(spark, name, odd, {"documents": f"{odd}/documents.parquet/*.parquet"})
