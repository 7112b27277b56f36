from pyspark.sql import functions as F

from . import brute
from tarn.llm import quality_rules as Q

LINE = "this very line stands on all the pages of the host as its footer"


FOOTERS = ("home news sports weather business culture travel opinion video audio games", "imprint privacy terms contact careers press advertise licence feedback sitemap archive")


def letters(text):
    """Digits as letters: the key of a line folds digits."""
    return str(text).translate(str.maketrans("0123456789", "abcdefghij"))


def unique(k, n=30):
    return " ".join(letters(f"w{k}x{i}") for i in range(n))


def test_counts(spark):
    eight = "a b c d e f g h"
    texts = [None, "", " \t\n ", "one", f"{eight} {eight}", "a " * 40, f"{unique(1)} {eight} x {eight} y {unique(2)}", "l1\nl1\n \nl2\nl1\r", "#*$%&|<> é\x0bw\x0c", unique(3, 20), "w " * 9000 + unique(4), "a\u00a0b \u2003c"]
    rows = list(enumerate(texts)) + [(4, texts[4]), (None, "x")]
    docs = spark.createDataFrame([(d, t, None if d == 3 else "h") for d, t in rows], "doc_id long, text string, source string").withColumn("host", F.lit("clash")).withColumn("lines", F.lit(1))
    got = Q.judge_documents(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        n, chars, symbols, dup, repeat, failed = brute.quality("x" if r["doc_id"] is None else texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, chars, symbols, dup, repeat, failed), r
        assert r["kept"] == (not failed)


def corpus():
    rows = [(k, f"{LINE}\n{unique(k)}\nother {letters(k)}", "h") for k in range(40)]  # the footer of all
    rows += [(100 + k, f"{LINE} \n{LINE.upper()}\nonly a few words {letters(k)} are left here of the page that is mostly footer", "h") for k in range(3)]
    rows += [(200, f"{LINE}\n{LINE}\n{LINE}\nfew own words", "h"), (201, f"{LINE}\n{LINE}\n{LINE}\nfew own words", "elsewhere")]
    rows += [(300 + k, "a good text that many copies share\n" + unique("copy", 25), "h") for k in range(60)]  # exact copies count once
    return rows


def test_lines_above_the_limits(spark):
    got = {r["doc_id"]: r for r in Q.judge_documents(spark.createDataFrame(corpus(), "doc_id long, text string, source string")).collect()}
    assert all(got[k]["kept"] and got[k]["n_removed_words"] == 14 for k in range(40))
    assert all(got[100 + k]["n_removed_words"] == 28 for k in range(3))
    assert got[200]["base_failed"] or not got[200]["kept"]
    assert got[201]["n_removed_words"] == 0
    assert all(got[300 + k]["kept"] and got[300 + k]["n_removed_words"] == 0 for k in range(60))


def test_each_copy_a_document(spark):
    rows = [*corpus(), (7, corpus()[50][1], "elsewhere"), (None, corpus()[50][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in Q.judge_documents(docs, each_copy=True).filter("doc_id >= 300 OR doc_id IS NULL").collect()}
    assert all(not got[300 + k]["kept"] and got[300 + k]["n_removed_words"] == 32 for k in range(60)) and got[None]["n_removed_words"] == 0
    kept = {r["doc_id"] for r in Q.clean_documents(docs, each_copy=True).collect()}
    assert not kept & set(range(300, 360)) and set(range(40)) <= kept


def test_hot_and_small_host(spark):
    rows = [(k, f"{unique(k)}\n{LINE}" if k < 120 else unique(k), "small") for k in range(300)]
    rows += [(5000 + k, f"{unique(k)}\n{LINE}" if k < 120 else unique(k), "hot") for k in range(2500)]
    got = {r["doc_id"]: r["n_removed_words"] for r in Q.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[first + k] == (14 if k < 120 else 0) for first in (0, 5000) for k in range(300))


def test_depleted(spark):
    rows = corpus() + [(400, f"{LINE}\n{FOOTERS[0]} 1\n{FOOTERS[1]}\nfew own words {unique('o', 3)}", "h")]
    rows += [(500 + k, f"{FOOTERS[0]} {k}\n{unique(f'p{k}')}\n {FOOTERS[1].upper()}", "h") for k in range(30)]
    got = {r["doc_id"]: r for r in Q.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[400]["n_removed_words"] == 14 + 12 + 11 and not got[400]["base_failed"] and not got[400]["kept"]
    assert all(got[500 + k]["kept"] and got[500 + k]["n_removed_words"] == 23 for k in range(30))


def test_clean_documents(spark):
    docs = spark.createDataFrame([(*r, None) for r in corpus()] + [(None, "tiny", None, None)], "doc_id long, text string, source string, n_chars long").withColumns({"host": F.lit("x"), "digest": F.lit("y"), "removed": F.lit(0), "key": F.lit(1)})
    out = Q.clean_documents(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert rows[0] == f"{unique(0)}\nother a" and rows[300].startswith("a good text") and None not in rows and 200 not in rows


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert Q.judge_documents(docs).count() == 0 and Q.clean_documents(docs).count() == 0
