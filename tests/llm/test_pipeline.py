"""The stages one after the other on a small corpus, each against brute force on its own input."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm import mixing, quality_rules
from tarn.llm import token_counts as C

from . import brute
from .test_preference_mixing import fitted

r = random.Random(9)
WORDS = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(900)]


def text(n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    footer, rows = "follow us on all the channels for news every day", []
    for k in range(120):
        body = text(60)
        rows.append((len(rows), f"{body}\n{footer}" if k % 2 else body, r.choice(["en", "de"]), f"s{k % 3}"))
        if k % 10 == 0:
            rows.append((len(rows), rows[-1][1], "en", f"s{k % 3}"))
        if k % 7 == 0:
            words = body.split(" ")
            words[30] = "changed"
            rows.append((len(rows), " ".join(words), "en", "s1"))
    rows += [(len(rows) + k, t, "en", "s0") for k, t in enumerate([None, "", "too short", "again and again " * 40])]
    rows.append((None, text(50), None, None))
    path = tmp_path_factory.mktemp("sf")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df.coalesce(1).write.parquet(str(path / "documents.parquet"))
    return str(path)


def brute_quality(rows):
    texts, hosts = defaultdict(set), defaultdict(set)
    lines_of = lambda t: [x for x in (t or "").split("\n") if brute.WORD.search(x)]
    key = lambda line: " ".join(line.lower().split())  # noqa: E731  the fixture has no digits
    for x in rows:
        hosts[x["source"]].add(x["text"] or "")
        for line in lines_of(x["text"]):
            texts[x["source"], key(line)].add(x["text"])
    out = {}
    for x in rows:
        limit = max(quality_rules.MIN_DOCUMENTS, quality_rules.MAX_SHARE * len(hosts[x["source"]]))
        kept = [line for line in (x["text"] or "").split("\n") if len(texts[x["source"], key(line)]) <= limit]
        n = brute.quality(x["text"])
        if not n[5] and sum(len(brute.WORD.findall(line)) for line in kept) >= quality_rules.KEEP_SHARE * n[0]:
            out[x["doc_id"]] = "\n".join(kept)
    return out


def test_stages(spark, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns

    def step(name, docs):
        out = stages[name](spark, docs, sf_dir).cache()
        return out, {x["doc_id"]: x for x in out.collect()}

    rows = docs.collect()
    docs, got = step("quality rules", docs)
    assert docs.columns == columns and {k: x["text"] for k, x in got.items()} == brute_quality(rows)
    assert all(x["n_chars"] == len(x["text"]) for x in got.values()) and any("channels" in (x["text"] or "") for x in rows) and not any("channels" in x["text"] for x in got.values())

    rows, (docs, got) = got, step("exact dedup", docs)
    last = {}
    for k, x in rows.items():
        last[x["text"]] = max(last.get(x["text"], -1), -1 if k is None else k)
    assert docs.columns == columns and {None if v == -1 else v for v in last.values()} == set(got)

    rows, (docs, got) = got, step("minhash near-dedup", docs)
    root, _ = brute.components([(k, x["text"]) for k, x in rows.items() if k is not None], 5, 80)
    assert docs.columns == columns and {k for k in got if k is not None} == {k for k, v in root.items() if k == v} and len(root) > len(got)

    rows = docs.select("doc_id", "source", "lang", mixing.topic_of(F.coalesce("text", F.lit(""))).alias("topic"), mixing.token_estimate(F.coalesce("text", F.lit(""))).alias("n_tokens"), F.expr("shiftrightunsigned(xxhash64(17, doc_id IS NULL, doc_id), 11) / power(2D, 53)").alias("draw")).collect()
    chance = fitted(rows, corpus_pipeline.TARGETS)
    chosen = {x["doc_id"] for x in rows if x["draw"] < chance[x["source"], x["lang"], x["topic"]]}
    docs, got = step("mixing to target weights", docs)
    assert docs.columns == columns and set(got) == chosen and 0.6 * len(rows) < len(chosen) < len(rows)

    rows, (docs, got) = got, step("sentencepiece encoding", docs)
    library = C.load(C.model_file())
    assert set(got) == set(rows)
    for k, x in got.items():
        assert x["token_ids"] == library.encode(rows[k]["text"]) and x["n_tokens"] == len(x["token_ids"])

    whole = {x["doc_id"]: x["token_ids"] for x in corpus_pipeline.run(spark, sf_dir).collect()}
    assert whole == {k: x["token_ids"] for k, x in got.items()}


def test_empty(spark, tmp_path):
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    spark.createDataFrame([], schema).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
