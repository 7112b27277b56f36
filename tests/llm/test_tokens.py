"""Token counts, and SentencePiece encoding and decoding."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import sentencepiece_viterbi as V
from tarn.llm import token_counts as C

r = random.Random(11)
TEXTS = [None, "", " ", "  ", "a", "Hello, world.\nSecond line\t tab", "a  b   c ", " ▁ y  ", "▁▁▁", "<s> </s> <unk> <0x0A>", "日本語 \U0001f600 \U0001f9d1‍\U0001f680", "x" * 3000, " " * 41 + "q" + " " * 16, "\x00a \x00", "0123456789 3.14", "http://www.example.com/a_b?c=d&e=f", "é" * 500, "aaaa  aaaaa   aaaaaa", "word " * 20_000]
TEXTS += ["".join(r.choice("ab cdethinr ▁éß日.\n") for _ in range(r.randint(0, 80))) for _ in range(400)]


@pytest.fixture(scope="module")
def library():
    return C.load(C.model_file())


@pytest.fixture(scope="module")
def vocabulary():
    return V.Vocabulary(C.model_file())


def test_pre_tokens_add_up(library):
    for t in TEXTS[1:]:
        assert sum(len(library.encode(p)) if p else 1 for p in C.pre_tokens(t)) == len(library.encode(t)), t


def test_counts(spark, library, monkeypatch):
    monkeypatch.setattr(C, "HOT_SHARE", 50)  # so that all three ways are taken
    rows = list(enumerate(TEXTS)) + [(4, "a"), (4, "a"), (None, "null id"), (11, "two rows of one id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("digest", F.lit(1)).repartition(4)
    got = sorted(map(tuple, C.count_tokens(docs, limit=100).collect()), key=repr)
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for d, t in rows]
    assert got == sorted(want, key=repr)
    assert C.count_tokens(docs.limit(0)).count() == 0


def test_texts_that_share_a_hash(spark, library):
    rows = [(d, t) for d in (None, 5) for t in TEXTS[:60]] + [(5, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = C.count_tokens(docs, digest=F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(40)))
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for d, t in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_very_many_texts_of_one_id(spark, library, doc_id):
    docs = spark.range(300_000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"))
    got = C.count_tokens(docs)
    assert got.count() == 300_000
    want = sum(len(x) for x in library.encode([f"text number {k}" for k in range(300_000)]))
    assert got.agg(F.sum("n_tokens")).first()[0] == want


def test_marks_are_no_pre_tokens(spark, library):
    texts = ["\x01" + "0" * 32, "\x00" + "a" * 32 + " \x01b", "\x01" * 49, "x" * 49 + " " + "\x00" * 60]
    got = {x["doc_id"]: x["n_tokens"] for x in C.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: len(library.encode(t)) for k, t in enumerate(texts)}


def test_encoding_is_the_librarys(library, vocabulary):
    encoder = V.Encoder(vocabulary)
    texts = [t or "" for t in TEXTS]
    for some in (texts, texts[:40], ["new words only"]):
        ids, counts = encoder.encode(some)
        ends = np.cumsum(counts)
        for t, end, n in zip(some, ends, counts, strict=True):
            assert ids[end - n : end].tolist() == library.encode(t), t
        assert V.decode_ids(vocabulary, ids, counts) == [t.replace("▁", " ") for t in some]


def test_long_words(library, vocabulary):
    """Words of several windows, with and without a seam, and words that are filled up."""
    own = random.Random(4)
    alphabets = ["ab", "x", "a", "xy=", "aeinrst", "abcdefghijklmnopqrstuvwxyz0123456789", "日本a\uffff", "the"]
    texts = ["".join(own.choice(a) for _ in range(n)) for a in alphabets for n in (23, 24, 25, 31, 32, 33, 240, 303, 304, 305, 306, 367, 368, 544, 545, 1000, 3400)]
    texts += ["the" * 3000, "x" * 1_000_000, "=" * 5000, " ".join("".join(own.choice("aeinrst") for _ in range(own.randint(20, 900))) for _ in range(60))]
    ids, counts = V.Encoder(vocabulary).encode(texts)
    ends = np.cumsum(counts)
    for t, end, n in zip(texts, ends, counts, strict=True):
        assert ids[end - n : end].tolist() == library.encode(t), t[:50]


def test_other_models_are_refused(tmp_path):
    assert V.model_type(b"\x12\x02\x18\x02") == 2 and V.model_type(b"\x12\x02\x20\x07") == 1 and V.model_type(b"") == 1
    (tmp_path / "unigram.model").write_bytes(b"\x0a\x05\x0a\x01a\x18\x01\x12\x02\x18\x01")
    with pytest.raises(ValueError, match="no BPE model"):
        V.Vocabulary(str(tmp_path / "unigram.model"))


def test_encoding_survives_forgetting(library, vocabulary, monkeypatch):
    monkeypatch.setattr(V, "HELD", 20)
    encoder = V.Encoder(vocabulary)
    for k in range(30):
        text = f"common words and {' '.join(r.choice(['alpha', 'beta', 'gamma']) + str(k + j) for j in range(10))}"
        assert encoder.encode([text])[0].tolist() == library.encode(text)


def test_pieces_that_follow(library, vocabulary):
    """Pairs of pieces, against encoding the joined text."""
    usable = [i for i in range(300, 31_000) if not library.id_to_piece(i).startswith("▁") and library.is_byte(i) is False]
    a = np.array([r.choice(usable) for _ in range(4000)])
    b = np.array([r.choice(usable) for _ in range(4000)])
    ok = V._follows(vocabulary, a, b)
    for x, y, fits in zip(a.tolist(), b.tolist(), ok.tolist(), strict=True):
        px, py = library.id_to_piece(x), library.id_to_piece(y)
        whole = V._merge(px + py, {p: library.get_score(i) for p in (px[k:m] for px in [px + py] for k in range(len(px)) for m in range(k + 1, len(px) + 1)) if (i := vocabulary.ids.get(p)) is not None})[0]
        assert fits == (whole == [px, py]), (px, py)


def test_frames(spark, library):
    rows = [*enumerate(TEXTS[:40]), (3, None), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("token_ids", F.lit("clash")).withColumn("lang", F.lit("en"))
    out = V.encode(docs)
    assert out.columns == ["doc_id", "text", "lang", "token_ids"]
    got = V.decode(out).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x["token_ids"] == library.encode(x["text"] or "") and x["decoded"] == (x["text"] or "").replace("▁", " ")
    query = {(x["doc_id"], x["n_tokens"], x["ids_crc32"], x["round_trip"], tuple(x["token_ids"])) for x in V.encode_documents(docs).collect()}
    assert query == {(d, len(ids := library.encode(t or "")), zlib.crc32(np.array(ids, "<i4").tobytes()), True, tuple(ids)) for d, t in rows}
    assert V.encode_documents(docs.limit(0)).count() == 0 and V.decode(V.encode(docs.limit(0))).count() == 0
