import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from . import brute
from tarn.llm import sharding


def test_jump_is_the_published_one(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 123456789, *range(-3000, 3000, 97)]
    for n in (1, 2, 8, 9, 40):
        got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_shard(F.col("k"), n).alias("s")).collect()
        assert all(r["s"] == brute.jump(r["k"] % 2**64, n) for r in got)


def test_contract(spark):
    rows = [(k, f"text {k % 7}" * (k % 5)) for k in range(400)] + [(3, None), (3, None), (None, "x"), (None, None), (9, "é" * 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(99))
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows)
    by_id, slots = defaultdict(set), defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and (r["grown_shard"] == r["shard"] or r["grown_shard"] == 8)
    assert all(len(v) == 1 for v in by_id.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(8))
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    moved = sum(r["grown_shard"] == 8 for r in got) / len(got)
    assert 0.05 < moved < 0.2


def test_slots_do_not_depend_on_partitions(spark):
    rows = [(k % 50, f"t{k % 9}") for k in range(300)]
    a, b = (sorted(map(tuple, sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect())) for n in (1, 7))
    assert a == b


def test_empty(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
