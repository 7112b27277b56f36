"""Quality rules: in-document counts, and the frequency of lines across the documents of a host.

Lines are normalised (trimmed, lower-cased, white space and digits folded) and hashed to 96 bits; for each host and line
the distinct documents are counted, a text that occurs many times counting once, so that exact copies of a good document
are no boilerplate; with `each_copy` every row counts as a document of its own. A line in more than MIN_DOCUMENTS of them and
in more than MAX_SHARE of the host's, or, however large the host, in more than MAX_DOCUMENTS, is above the limit and is
removed. A document that keeps less than KEEP_SHARE of its words is depleted and is rejected, as is one that fails the base
rules (fewer than 20 words, or over 30 % of its words in repeated 8-word windows).

What is shuffled are hashes and counts, keyed by host, text digest and line, after aggregation within each task; no text
and no list of all documents with a line. A very frequent line is one key of an aggregation with partial sums, and one
key of a sort-merge join whose partitions adaptive execution splits.

Defined results: a null text has no words; null hosts are one host. Repeated rows get equal results. Very long texts are
counted whole. An empty table gives an empty result. Columns other than those named are passed on untouched by
`clean_documents` and not read by `judge_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, stage_table, text_of, words_of

MIN_DOCUMENTS = 10
MAX_SHARE = 0.08
MAX_DOCUMENTS = 100
KEEP_SHARE = 0.3
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of `width` words found twice or more in the text, the first time included."""

    def covered(placed: Column) -> Column:
        # Windows in the order of their hash; a neighbour with the same hash makes a repeat.
        same = lambda k, x: F.coalesce(F.get(placed, k)["h"] == x.h, F.lit(False))
        repeats = F.filter(F.transform(placed, lambda x, k: F.when(same(k - 1, x) | same(k + 1, x), x.i)), lambda i: i.isNotNull())
        step = lambda acc, i: F.struct((acc.n + F.least(F.lit(width), i + width - acc.end)).alias("n"), (i + width).alias("end"))
        return F.aggregate(F.sort_array(repeats), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc.n)

    def judged(hashes: Column) -> Column:
        # Nearly all documents have no repeat, and end at the comparison of two sizes.
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(placed, covered))

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(-1, width - 1)]))
        return F.when(F.size(w) <= width, 0).otherwise(let(hashes, judged))

    return let(words, windows)


def lines_of(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, r"[0-9]+", "0"), r"\s+", " ")))


def _key(normal: Column) -> Column:
    return F.struct(F.xxhash64(normal).alias("h1"), F.hash(normal).alias("h2"))


def line_key(line: Column) -> Column:
    return let(_normal(line), _key)


def _keyed(line: Column) -> Column:
    """Key and words of a line that has a word; in its normal form one space stands between two words."""
    words = lambda normal: F.octet_length(normal) - F.octet_length(F.replace(normal, F.lit(" "), F.lit(""))) + 1
    return let(_normal(line), lambda normal: F.struct(_key(normal).alias("key"), words(normal).alias("words")))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def measures(text: Column) -> Column:
    """The counts of a text as a struct; its words are taken once."""
    lines = lambda some: F.size(some) - F.size(F.array_distinct(some))
    symbols = F.octet_length(text) - F.octet_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))  # of one byte each
    return let(
        words_of(text),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            let(lines_of(text), lines).cast("long").alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        ),
    )


def narrow_rows(docs: DataFrame, id_col: str, host_col: str, text_col: str) -> DataFrame:
    """The counts, the digest and the line keys of each document, staged: texts are read once."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    return stage_table(
        rows.select(
            "doc_id",
            "host",
            _digest(F.col("text")).alias("digest"),
            measures(F.col("text")).alias("m"),
            F.transform(lines_of(F.col("text")), _keyed).alias("lines"),
        ).select("doc_id", "host", "digest", "m.*", "lines"),
        "quality-rows",
    )


def removed_lines(rows: DataFrame, each_copy: bool = False) -> DataFrame:
    """(host, digest, removed): the keys of a text's lines that are above the limits, for texts that have any."""
    copies = (F.count(F.lit(1)) if each_copy else F.lit(1).cast("long")).alias("copies")
    lines = rows.select("host", "digest", F.explode(F.array_distinct(F.transform("lines", lambda x: x.key))).alias("key"))
    lines = stage_table(lines.groupBy("host", "digest", "key").agg(copies), "quality-lines")
    texts = rows.groupBy("host", "digest").agg(copies).groupBy("host").agg(F.sum("copies").alias("documents"))
    counts = lines.groupBy("host", "key").agg(F.sum("copies").alias("n")).filter(F.col("n") > MIN_DOCUMENTS)
    above = counts.join(texts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).filter(F.col("n") > F.least(MAX_SHARE * F.col("documents"), F.lit(float(MAX_DOCUMENTS))))
    above = above.select(F.col("host").alias("_host"), F.col("key").alias("_key"))
    found = lines.join(above, F.col("host").eqNullSafe(F.col("_host")) & (F.col("key") == F.col("_key")))
    return found.groupBy("host", "digest").agg(F.collect_set("key").alias("removed"))


def judge_rows(rows: DataFrame, each_copy: bool = False) -> DataFrame:
    """rows with removed, n_removed_words, base_failed and kept."""
    gone = removed_lines(rows, each_copy).select(F.col("host").alias("_host"), F.col("digest").alias("_digest"), "removed")
    out = rows.join(gone, F.col("host").eqNullSafe(F.col("_host")) & (F.col("digest") == F.col("_digest")), "left").drop("_host", "_digest")
    lost = F.aggregate("lines", F.lit(0).cast("long"), lambda acc, x: acc + F.when(F.array_contains(F.col("removed"), x.key), x.words).otherwise(0).cast("long"))
    out = out.withColumn("n_removed_words", F.when(F.col("removed").isNull(), F.lit(0).cast("long")).otherwise(lost))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_removed_words") < KEEP_SHARE * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~depleted)


def judge_documents(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", each_copy: bool = False) -> DataFrame:
    """Return doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words."""
    return judge_rows(narrow_rows(docs, id_col, host_col, text_col), each_copy).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def clean_documents(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", each_copy: bool = False) -> DataFrame:
    """The documents that are kept, all columns, with the lines above the limits taken out of the text.

    A verdict depends on host and text alone, so it is joined by these two."""
    judged = judge_rows(narrow_rows(docs, id_col, host_col, text_col), each_copy).filter("kept")
    verdicts = judged.groupBy(F.col("host").alias("__tarn_host"), F.col("digest").alias("__tarn_digest")).agg(F.any_value("removed").alias("__tarn_removed"))
    marked = docs.withColumns({"__tarn_h": F.col(host_col).cast("string"), "__tarn_d": _digest(text_of(text_col))})
    out = marked.join(verdicts, F.col("__tarn_h").eqNullSafe(F.col("__tarn_host")) & (F.col("__tarn_d") == F.col("__tarn_digest")))
    rest = F.filter(F.split(text_col, "\n"), lambda line: ~F.array_contains(F.col("__tarn_removed"), line_key(line)))
    return out.withColumn(text_col, F.when(F.col("__tarn_removed").isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n"))).select(*docs.columns)
