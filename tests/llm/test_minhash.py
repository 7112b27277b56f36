import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import brute
from tarn.llm import minhash as M

r = random.Random(5)
VOCABULARY = [f"v{k}" for k in range(3000)]


def text(n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(t, share):
    return " ".join(r.choice(VOCABULARY) if r.random() < share else w for w in t.split(" "))


def corpus():
    rows = [None, "", " \n", "one", "one two", "ONE two", "one two three", "same words here again", "Same WORDS here\tagain", "x " * 3000]
    for _ in range(4):
        base = text(120)
        rows += [base, base, base.upper()] + [edited(base, s) for s in (0.005, 0.01, 0.02, 0.03, 0.04, 0.06, 0.1, 0.2)] * 2
    passage = text(150)
    rows += [f"{passage} {text(k)}" for k in range(20, 200, 12)]  # a passage that many share, at all similarities
    chain = [text(100)]
    for _ in range(12):
        chain.append(edited(chain[-1], 0.03))
    return rows + chain + [text(n) for n in range(3, 60)]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_brute_force(spark, width, percent):
    rows = list(enumerate(corpus()))
    r.shuffle(rows)
    root, sets = brute.components(rows, width, percent)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("clash")).withColumn("n", F.lit(0)).repartition(5)
    got = M.near_dedup_documents(docs, width, percent).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x["n_shingles"] == len(sets[x["doc_id"]])
        assert x["component_id"] == root[x["doc_id"]]
        assert x["kept"] == (x["doc_id"] == x["component_id"])


def test_all_bands_are_looked_at_again(spark):
    """With many rows a band, linked pairs beside the stars often share later bands only."""
    own, bands, rows, percent = random.Random(8), 40, 60, 95
    texts = []
    for _ in range(60):
        words = lambda n: [f"u{own.randrange(10**9)}" for _ in range(n)]
        hub, both = words(400), words(14)
        texts += [hub, *([*hub, f"e{k}"] for k in range(4)), *([*hub, *both, *words(9)] for _ in range(2))]  # 0.945 to the hub, 0.958 to one another
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = [x["sh"] for x in docs.select("doc_id", M.shingles(F.col("text"), 3).alias("sh")).orderBy("doc_id").collect()]
    keys = M.signatures(np.array([h for s in sets for h in s], np.int64).view(np.uint64), np.cumsum([0, *map(len, sets)]), bands, rows)
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a // 7 * 7, a):
            common = len(set(sets[a]) & set(sets[b]))
            if (keys[a] == keys[b]).any() and common * 100 >= (len(sets[a]) + len(sets[b]) - common) * percent:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    got = {x["doc_id"]: x["component_id"] for x in M.near_duplicates(docs, 3, percent, bands, rows).collect()}
    assert got == dict(enumerate(root))


def test_repeated_rows_and_null_ids(spark):
    base = text(60)
    docs = spark.createDataFrame([(5, base), (5, base), (4, base), (None, base), (None, "alone in the world"), (9, None)], "doc_id long, text string")
    got = sorted(((x["doc_id"], x["component_id"], x["kept"]) for x in M.near_dedup_documents(docs).collect()), key=repr)
    assert got == sorted([(5, 4, False), (5, 4, False), (4, 4, True), (None, 4, False), (None, None, True), (9, 9, True)], key=repr)


def test_empty(spark):
    assert M.near_dedup_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_drop_near_copies(spark):
    base = text(80)
    docs = spark.createDataFrame([(3, base, "a"), (7, edited(base, 0.01), "b"), (8, text(80), "c"), (9, None, "d")], "doc_id long, text string, source string").withColumns({"component_id": F.lit(0), "cls": F.lit(1), "_gone": F.lit(2)})
    out = M.drop_near_copies(docs)
    assert out.columns == docs.columns and sorted(x["doc_id"] for x in out.collect()) == [3, 8, 9]


def test_drop_near_copies_with_null_and_repeated_ids(spark):
    base, other, third = text(80), text(80), text(80)
    rows = [(3, base), (None, edited(base, 0.01) + " end"), (None, other), (None, other + " end"), (None, "alone with a null id"), (None, None), (None, None)]
    rows += [(5, third), (6, third + " end"), (6, "alone with a repeated id"), (5, third)]
    out = [tuple(x) for x in M.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    null_kept = [t for d, t in out if d is None and t and t.startswith(other)]
    assert len(null_kept) == 1
    rest = [(3, base), (None, "alone with a null id"), (None, None), (None, None), (5, third), (5, third), (6, "alone with a repeated id")]
    assert sorted(out, key=repr) == sorted([*rest, (None, null_kept[0])], key=repr)


def test_densification_fills_from_filled_bins():
    bins = np.full((3, 50), M._EMPTY, np.uint64)
    bins[0, [3, 40]] = [7, 8]
    bins[1] = np.arange(50)
    out = M.densify(bins)
    assert set(out[0].tolist()) == {7, 8} and (out[1] == np.arange(50)).all() and (out[2] == M._EMPTY).all()


def test_bands_estimate_similarity():
    rng = np.random.default_rng(1)
    hits = []
    for _ in range(60):
        common, a, b = (rng.integers(1, 2**62, n).astype(np.uint64) for n in (800, 100, 100))
        keys = M.signatures(np.concatenate([common, a, common, b]), np.array([0, 900, 1800]), 40, 5)
        hits.append((keys[0] == keys[1]).mean())
    assert abs(np.mean(hits) - 0.8**5) < 0.06


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    common, a, b = (rng.integers(1, 2**62, n).astype(np.uint64) for n in (1700, 150, 150))
    sketch = M.sketches(np.concatenate([common, a, common, b]), np.array([0, 1850, 3700])).view(np.uint64)
    differ = sum(int(x ^ y).bit_count() for x, y in zip(sketch[0].tolist(), sketch[1].tolist(), strict=True))
    assert abs(1 - 2 * differ / M.SKETCH_BITS - 0.85) < 0.12


def test_exact(spark):
    """With one band of many rows next to nothing shares a bucket, and the exact way finds all links."""
    rows = list(enumerate(corpus()))
    root, _ = brute.components(rows, 3, 85)
    got = {x["doc_id"]: x["component_id"] for x in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 1, 60, exact=True).collect()}
    assert got == root


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(M, "SPLIT_ROWS", 3)
    rows = list(enumerate(corpus()))
    root, _ = brute.components(rows, 3, 85)
    got = {x["doc_id"]: x["component_id"] for x in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 85).collect()}
    assert got == root


@pytest.mark.parametrize("rows", [0, 4, 1000])
def test_pairs_of_small_buckets_and_links_inside_large_ones(spark, monkeypatch, rows):
    monkeypatch.setattr(M, "PAIR_ROWS", rows)
    docs = list(enumerate(corpus()))
    root, _ = brute.components(docs, 3, 85)
    got = {x["doc_id"]: x["component_id"] for x in M.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 3, 85).collect()}
    assert got == root


def test_sets_are_not_shuffled_for_each_row_of_a_small_bucket(spark):
    """Six texts that each lack another sixth share bands and shingles, but no two are linked."""
    own, texts = random.Random(12), []
    for _ in range(60):
        parts = [" ".join(f"u{own.randrange(10**9)}" for _ in range(100)) for _ in range(6)]
        texts += [" ".join(p for j, p in enumerate(parts) if j != k) for k in range(6)]
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(store.executorList(True).apply(k).totalShuffleWrite() for k in range(store.executorList(True).size()))
    before, least = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = M.near_dedup_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert all(x["kept"] for x in got) and len(got) == 360
    times = (written() - before) / sum(map(len, texts))
    assert times < 14


def test_shuffle_files_go_with_each_staged_table(spark):
    """What the staged tables stand for is not kept on disk until the driver collects its garbage."""
    own = random.Random(13)
    bases = [[f"u{own.randrange(10**9)}" for _ in range(200)] for _ in range(60)]
    texts = [" ".join([*b, f"e{k}"]) for b in bases for k in range(4)]
    env, store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get(), spark.sparkContext._jsc.sc().statusStore()

    def held():
        files = env.blockManager().diskBlockManager().getAllFiles()
        files = [files.apply(k) for k in range(files.size())]
        return {(f.getPath(), f.length()) for f in files if f.getName().startswith("shuffle_")}

    written = lambda: sum(store.executorList(True).apply(k).totalShuffleWrite() for k in range(store.executorList(True).size()))
    files, before, least = held(), written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        M.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert sum(size for _, size in held() - files) * 20 < written() - before


def test_marked_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(2000)] + [(None, "null"), (7, "again")], "k long, t string")
    wanted = spark.createDataFrame([(7,), (1999,), (None,), (7,), (5000,)], "w long")
    assert sorted(x["t"] for x in M._marked(rows, "k", wanted, "w").collect()) == ["again", "null", "t1999", "t7"]
    assert M._marked(rows, "k", wanted.limit(0), "w").count() == 0
    monkeypatch.setattr(M, "MARK_BITS", 1)
    assert M._marked(rows, "k", wanted, "w").count() == 2002
