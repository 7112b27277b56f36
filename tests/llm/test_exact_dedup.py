import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tarn.llm import exact_dedup

ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (6, "a "), (None, "a"), (None, "lonely"), (7, "long " * 50_000), (8, "long " * 50_000)]


def expected(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for text, docs in groups.items():
        keep = max((d for d in docs if d is not None), default=None)
        left = 1
        for d in docs:
            out.append((d, keep, len(docs), d == keep and left == 1, hashlib.sha256(text.encode()).hexdigest()))
            left -= d == keep
    return sorted(out, key=repr)


def test_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("copies", F.lit(0))
    got = [tuple(r) for r in exact_dedup.dedup_documents(docs).collect()]
    assert sorted(got, key=repr) == expected(ROWS)


def test_choice_of_history_changes_nothing(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    every = [sorted(map(repr, exact_dedup.exact_dedup(docs, historical=h).collect())) for h in (F.lit(True), F.lit(False), F.col("doc_id") % 2 == 0)]
    assert every[0] == every[1] == every[2]


def test_empty(spark):
    assert exact_dedup.dedup_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_drop_copies_keeps_columns_and_one_of_identical_rows(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (5, "b", "p"), (5, "b", "q"), (6, None, "n"), (None, "z", "w")], "doc_id long, text string, source string").withColumns({"copies": F.lit(9), "digest": F.lit("d"), "_id": F.lit(1)})
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    rows = [tuple(r[:3]) for r in out.collect()]
    assert sorted(r[:2] for r in rows if r[0] is not None) == sorted([(2, "a"), (5, "b"), (6, None)], key=lambda r: r[0])
    assert (None, "z", "w") in rows and len(rows) == 4


def test_minimal_perfect_hash():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(k).encode()).digest() for k in range(5000)), np.uint8).reshape(-1, 32)
    mph = exact_dedup.PerfectHash(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(5000))
    assert exact_dedup.PerfectHash(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]


def test_against_a_table_of_earlier_documents(spark):
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    history, docs = table([(1, "a"), (2, "a"), (10**15, "b"), (None, "old only")]), table([(5, "a"), (6, "c"), (7, "c"), (7, "c"), (8, None), (None, "b")])
    got = {(x["doc_id"], x["copies"], x["keep_id"], x["group_size"], x["known"]) for x in exact_dedup.new_documents(docs, history).collect()}
    assert got == {(5, 1, 5, 3, True), (6, 1, 7, 3, False), (7, 2, 7, 3, False), (8, 1, 8, 1, False), (None, 1, 10**15, 2, True)}
    assert exact_dedup.new_documents(docs.limit(0), history).count() == 0 and {x["known"] for x in exact_dedup.new_documents(docs, history.limit(0)).collect()} == {False}
