"""Exact dedup against a minimal perfect hash of the historical digests.

The historical distinct digests are cut into buckets by a digest prefix, and each bucket gets a minimal perfect hash:
levels of bit arrays in which a digest that is alone at its position settles, while the others go on to the next level;
the rank of the settled bit is the slot. A slot holds the full digest and the locator (doc_id) of the row that wins, with
the number of rows seen. Incoming digests are looked up slot by slot and compared byte by byte: members are repeats of
the history, nonmembers are grouped separately among themselves.

Every shuffle carries digests and ids, never texts, and follows a map-side aggregation, so a text that a third of all
rows share costs one row per task. Buckets hold some BUCKET_DIGESTS distinct digests whatever the size of the corpus.

Defined results: a null text counts as empty. Null ids rank below all others; a group with null ids only has a null
keep_id. Of identical rows (same id, same text) one stays. Clashing extra columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table, text_of

#: Distinct historical digests to a bucket; some 100 bytes each in the task that builds it.
BUCKET_DIGESTS = 100_000
#: Bits for each digest that is still unplaced, at every level.
LOAD = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _position(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Position of each digest (four 64-bit words) in the bit array of a level."""
    with np.errstate(over="ignore"):
        x = words[:, level % 4] ^ (words[:, (level + 1) % 4] * (_MIX + np.uint64(2 * level)))
        x = (x ^ (x >> np.uint64(31))) * _MIX
        x = x ^ (x >> np.uint64(29))
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash over distinct 32-byte digests, given as an (n, 32) array of bytes."""

    def __init__(self, digests: np.ndarray):
        words = np.ascontiguousarray(digests).view(np.uint64).reshape(len(digests), 4)
        self.n, self.bits, left, level = len(digests), [], np.arange(len(digests)), 0
        while len(left):
            size = LOAD * len(left) + 1
            at = _position(words[left], level, size)
            alone = np.bincount(at, minlength=size) == 1
            self.bits.append(alone)
            left, level = left[~alone[at]], level + 1
        self.first = np.cumsum([0, *(int(b.sum()) for b in self.bits)])
        self.ranks = [np.cumsum(b) - 1 for b in self.bits]

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; for one that was not among the keys some slot or -1, hence the byte check."""
        words = np.ascontiguousarray(digests).view(np.uint64).reshape(len(digests), 4)
        out, left = np.full(len(digests), -1), np.arange(len(digests))
        for level, bits in enumerate(self.bits):
            if not len(left):
                break
            at = _position(words[left], level, len(bits))
            here = bits[at]
            out[left[here]] = self.first[level] + self.ranks[level][at[here]]
            left = left[~here]
        return out


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 32)


_CLASSES = "digest binary, keep_id long, group_size long, member boolean"
_SIDE = pa.schema([("bucket", pa.int32()), ("digest", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64())])


def _look_up(old: pa.Table, new: pa.Table) -> pa.Table:
    """One bucket: hash the history, look the incoming digests up, merge members into their slot."""
    old, new = (t if len(t) else _SIDE.empty_table() for t in (old, new))
    keys = _bytes(old["digest"])
    mph = PerfectHash(keys)
    at_slot = np.empty(mph.n, np.int64)
    at_slot[mph.slots(keys)] = np.arange(mph.n)
    slots = old.take(pa.array(at_slot))  # slot by slot: full digest, locator of the winner, rows seen
    slot_digest, probe = keys[at_slot], _bytes(new["digest"])
    at = mph.slots(probe)
    member = at >= 0
    member[member] = (slot_digest[at[member]] == probe[member]).all(axis=1)
    partner = np.full(mph.n, -1)  # a digest has one row on either side
    partner[at[member]] = np.flatnonzero(member)
    found = new.take(pa.array(partner, mask=partner < 0))
    alone = new.filter(pa.array(~member))
    merged = pa.table(
        {
            "digest": slots["digest"],
            "keep_id": pc.max_element_wise(slots["keep_id"], found["keep_id"]),
            "group_size": pc.add(slots["n"], pc.fill_null(found["n"], 0)),
            "member": pa.array(partner >= 0),
        }
    )
    apart = pa.table({"digest": alone["digest"], "keep_id": alone["keep_id"], "group_size": alone["n"], "member": pa.array(np.zeros(len(alone), bool))})
    return pa.concat_tables([merged, apart])


def exact_dedup(docs: DataFrame, historical: Column | None = None, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """Return (id, digest binary, copies, keep_id, group_size) for each distinct (id, text); the largest id of a text wins.

    historical: which rows are the history, by default those with an id up to about the median. The result does not depend on
    the choice, only the work does."""
    digest = F.unhex(F.sha2(text_of(text_col), 256)) if digest is None else digest
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("digest"), *([F.coalesce(historical, F.lit(False)).alias("old")] if historical is not None else []))
    rows = stage_table(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")), "dedup-rows")
    n, middle = rows.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", 0.5, F.lit(1000))).first()
    if historical is None:
        rows = rows.withColumn("old", F.coalesce(F.col("doc_id") <= F.lit(middle).cast("long"), F.lit(False)))
    buckets = max(1, -(-n // BUCKET_DIGESTS))
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")
    side = lambda old: rows.filter(F.col("old") if old else ~F.col("old")).groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("n")).select(bucket, F.col("digest").alias("digest"), "keep_id", "n")  # noqa: E731  own attributes on either side
    classes = side(True).groupBy("bucket").cogroup(side(False).groupBy("bucket")).applyInArrow(_look_up, _CLASSES)
    # A class of one row needs no join: only the others are looked up.
    many = classes.filter("group_size > 1").select("digest", "keep_id", "group_size")
    return rows.select("doc_id", "digest", "copies").join(many.withColumn("hit", F.lit(True)), "digest", "left").select(
        "doc_id", "digest", "copies", F.when(F.col("hit"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size")
    )


def dedup_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    out = exact_dedup(docs)
    return out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def new_documents(docs: DataFrame, history: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, copies, keep_id, group_size, known) of each distinct (id, text) of docs against a table of earlier documents;
    known says whether the history has the text. Ids are compared over both tables."""
    side = lambda df, old: df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(old).alias("old"))
    both = side(docs, False).unionByName(side(history, True))
    found = exact_dedup(both, F.col("old")).dropDuplicates(["digest"]).select("digest", "keep_id", "group_size")
    seen = side(history, True).select(F.unhex(F.sha2(text_of("text"), 256)).alias("digest")).distinct().withColumn("hit", F.lit(True))
    own = side(docs, False).select("doc_id", F.unhex(F.sha2(text_of("text"), 256)).alias("digest")).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    return own.join(found, "digest").join(seen, "digest", "left").select("doc_id", "digest", "copies", "keep_id", "group_size", F.col("hit").isNotNull().alias("known"))


def drop_copies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without exact copies, all columns kept: one row of each text stays, that with the largest doc_id."""
    columns = docs.columns
    marked = docs.withColumn("__tarn_digest", F.unhex(F.sha2(text_of(text_col), 256)))
    found = exact_dedup(docs, text_col=text_col)
    won = found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("__tarn_id"), F.col("digest").alias("__tarn_d"), F.col("copies").alias("__tarn_copies"))
    out = marked.join(won, F.col("doc_id").cast("long").eqNullSafe(F.col("__tarn_id")) & (F.col("__tarn_digest") == F.col("__tarn_d")), "inner")
    # Identical rows of the winner itself: of these one stays, whichever comes first.
    once, tied = out.filter("__tarn_copies = 1"), out.filter("__tarn_copies > 1")
    tied = tied.groupBy("__tarn_digest").agg(F.any_value(F.struct(*columns)).alias("r")).select("r.*")
    return once.select(*columns).unionByName(tied)
