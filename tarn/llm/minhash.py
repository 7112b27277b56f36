"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

Documents with the same set of word shingles are one class. Each class gets a signature from a single permutation: the
shingle hashes are dealt to BANDS x ROWS bins and each bin keeps its least; an empty bin borrows from a bin that a
universal hash of (bin, attempt) names, tried until one is filled. Bands of the signature are buckets.

In a bucket the class that shares most with others (the sum of the sizes of its buckets) is the hub, and candidate edges
go from the hub to the other classes: a star, not all pairs. Each class is compared with the best of its hubs, on the full
shingle sets. In a group of copies of one text that text is the hub, so the group is linked by about one edge a class.

A star alone would lose a link between two classes that are both unlike the hub. Buckets whose classes are still in more
than one component are therefore looked at again, GROUP_BANDS bands at a time and all of them in the end, each group with
the components that the one before left. There an exact bound decides, taken once over the buckets of all bands: a shingle
that no other class in these buckets has is in no intersection, so of n shingles with u such, no more than n - u can be
common. Classes that can reach the similarity with nobody drop out; of the others, classes of different components in one bucket that the bound lets pass are
compared, and a sketch of SKETCH_BITS one-bit minima spares most pairs that are too unlike the full comparison. A row of a
bucket of up to PAIR_ROWS rows takes the sketch only to the join, whose distinct pairs are then confirmed on full sets: at
most (PAIR_ROWS - 1) / 2 a row. In larger buckets rows take their sets along, which are compared as the condition of the
join, so only links leave it. The sketch fails a linked pair with a probability of 3e-6, so each group has a sketch of its
own, which gives the pair another chance; a single group has none, and there, as in `drop_near_copies`, whose pipeline has
less of the driver's memory left for plans, all buckets count as large. A pair at the least
similarity shares no band with a probability of 1e-10 (0.85, by 40 bands of 5 rows) or 1e-7 (0.8). Buckets of more than
SPLIT_ROWS rows in that look are dealt to several tasks, each of which compares a part of the bucket with all of it.

`exact` is the way for those who can't accept such odds: after the stars, all classes of different components that share one
of their rarest shingles are compared. Of n shingles the n - ceil(n x similarity) + 1 rarest in the corpus will do, since two
sets that are similar enough can't differ in all of these.

Texts and sets that are wanted by a few go through a broadcast bitmap of a fixed size before they are shuffled.

Shingles are 64-bit hashes. Links and components are tables; labels are propagated with pointer jumping, and each round
is staged in the shared folder. Nothing but counts comes to the driver.

Defined results: words are those of the lower-cased (A-Z) text; a text with fewer words than a shingle is one shingle; a
text without words, or null, has no shingles, is linked with nothing and stays. component_id is the least id reachable.
Repeated rows are one class and share their component. Rows with a null id take part, and rank last among ids. Extra
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, let, stage_table, text_of, words_of

BANDS, ROWS = 40, 5
#: Bands that are looked at again at once for links beside the stars.
GROUP_BANDS = 20
SKETCH_BITS = 512
#: Rows of a bucket up to which pairs leave the join before their sets are compared.
PAIR_ROWS = 16
#: Rows of a bucket that one task compares with the bucket.
SPLIT_ROWS = 2000
#: Bits of the broadcast bitmap of `_marked`: 1 MB.
MARK_BITS = 1 << 23
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def shingles(text: Column, width: int) -> Column:
    """Hashes of the distinct shingles of `width` words."""

    def hashed(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) == 0, F.array().cast("array<long>")).when(F.size(w) < width, F.array(F.xxhash64(w))).otherwise(F.array_distinct(each))

    return let(words_of(ascii_lower(text)), hashed)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * _MIX1
        x = (x ^ (x >> np.uint64(33))) * _MIX2
        return x ^ (x >> np.uint64(33))


def densify(bins: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row from the bin that a hash of (bin, attempt) names; only filled bins are borrowed from."""
    m = bins.shape[1]
    filled, out = bins != _EMPTY, bins.copy()
    rows, at = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        source = (_mix(at.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt)) % np.uint64(m)).astype(np.int64)
        hit = filled[rows, source]
        out[rows[hit], at[hit]] = bins[rows[hit], source[hit]]
        rows, at = rows[~hit], at[~hit]
    return out


def signatures(hashes: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys, one row for each set; hashes of set k are hashes[offsets[k]:offsets[k + 1]]."""
    m, n = bands * rows, len(offsets) - 1
    mixed = _mix(hashes.astype(np.uint64))
    bins = np.full(n * m, _EMPTY, np.uint64)
    of = np.repeat(np.arange(n), np.diff(offsets))
    np.minimum.at(bins, of * m + (mixed % np.uint64(m)).astype(np.int64), mixed // np.uint64(m))
    full = densify(bins.reshape(n, m)).reshape(n, bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
    for k in range(rows):
        key = _mix(key * np.uint64(31) + full[:, :, k])
    return key.astype(np.int64)


_SET_ROWS = 512


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64), offsets - offsets[0]


def _set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(np.sort(hashes).tobytes(), digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), _SET_ROWS):
            batch = whole.slice(at, _SET_ROWS)
            hashes, offsets = _flat(batch.column(1))
            keys = signatures(hashes, offsets, bands, rows)
            cls = [_set_key(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(cls, pa.binary()), lists, *batch.columns[2:]], names=["doc_id", "n", "cls", "bands", *batch.schema.names[2:]])


def _key_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, offsets = _flat(batch.column(1))
        cls = [_set_key(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), batch.column(1)], names=["want", "cls", "sh"])


def sketches(hashes: np.ndarray, offsets: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bit of the minimum under each of SKETCH_BITS hash functions of the seed, packed into longs, one row for each set."""
    a = _mix(np.arange(1, SKETCH_BITS + 1, dtype=np.uint64) + np.uint64(seed * SKETCH_BITS)) | np.uint64(1)
    bits = np.zeros((len(offsets) - 1, SKETCH_BITS), bool)
    for k, (start, end) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        low = np.full(SKETCH_BITS, _EMPTY)
        for at in range(start, end, 1024):
            with np.errstate(over="ignore"):
                h = hashes[at : min(at + 1024, end), None] * a
                h = (h ^ (h >> np.uint64(32))) * _MIX1
            low = np.minimum(low, h.min(axis=0))
        bits[k] = _mix(low) >> np.uint64(63)
    return np.packbits(bits, axis=1).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], seeds: int) -> Iterator[pa.RecordBatch]:
    """The sketches of each seed from 0 on, one after another in a list."""
    for batch in batches:
        made = np.hstack([sketches(*_flat(batch.column(1)), seed) for seed in range(seeds)])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, made.shape[1], dtype=np.int32)), pa.array(made.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["cls", "sketch"])


def _alike(percent: int) -> Column:
    """Whether the sketches differ in no more bits than sets of the least similarity do, with 4.5 standard deviations added."""
    p = (1 - percent / 100) / 2
    most = int(SKETCH_BITS * p + 4.5 * (SKETCH_BITS * p * (1 - p)) ** 0.5)
    differ = [F.bit_count(F.get("sketch", F.lit(k)).bitwiseXOR(F.get("sketch_b", F.lit(k)))) for k in range(SKETCH_BITS // 64)]
    return reduce(Column.__add__, differ) <= most


def _staged(df: DataFrame, label: str) -> DataFrame:
    """stage_table, whose shuffle files go as soon as the table is written, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return stage_table(df, label)
    finally:
        conf.set(_CLEANUP, before)


def _marked(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows whose key is among the wanted ones (null too), and others by chance: with w wanted keys at most w / MARK_BITS of them.

    A bitmap is broadcast, of the same size for any corpus, so rows that a later join drops are not shuffled."""
    mark = lambda name: F.pmod(F.xxhash64(name), F.lit(MARK_BITS)) + 1
    place = F.bitmap_bit_position(mark(wanted_key))
    bits = wanted.groupBy(F.bitmap_bucket_number(mark(wanted_key)).alias("_block")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    place = F.bitmap_bit_position(mark(key))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(bits), F.bitmap_bucket_number(mark(key)) == F.col("_block"))
    return met.filter(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1).select(*rows.columns)


def _components(edges: DataFrame) -> DataFrame:
    """(cls, root): the least class key that edges (a, b) reach, for all classes on an edge."""
    both = _staged(edges.select(F.col("a"), F.col("b")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "minhash-edges")
    labels = _staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "cls"), "minhash-labels")
    while True:
        near = both.join(labels.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("root").alias("near"))
        lowered = labels.join(near, "cls").select("cls", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        # Pointer jumping: go on to the label of the label.
        jump = labels.select(F.col("cls").alias("root"), F.col("root").alias("further"))
        lowered = lowered.join(jump, "root", "left").select("cls", "was", F.least("root", F.coalesce("further", "root")).alias("root"))
        lowered = _staged(lowered, "minhash-labels")
        moved = lowered.filter("root != was").limit(1).count()
        labels = lowered.select("cls", "root")
        if not moved:
            return labels


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar: 100 * intersection >= percent * union."""
    left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("sh").alias("sh_a")), "a")
    both = left.join(sets.select(F.col("cls").alias("b"), F.col("sh").alias("sh_b")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("sh_a", "sh_b")).alias("i"), (F.size("sh_a") + F.size("sh_b")).alias("t"))
    return common.filter(F.col("i") * 100 >= (F.col("t") - F.col("i")) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """Return doc_id, n_shingles, cls (16-byte key of the shingle set) and component_id, one row for each document."""
    out = _grouped(docs, width, percent, bands, rows, id_col, text_col, exact=exact)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "cls", F.when(F.col("n") > 0, F.coalesce("id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _grouped(docs: DataFrame, width: int, percent: int, bands: int, rows: int, id_col: str, text_col: str, digest: bool = False, exact: bool = False, pair_rows: int | None = None) -> DataFrame:
    """doc_id, n, cls, root (least class of the component, null for a class without links), id, and the digest of the text if asked."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    more = [_digest(F.col("text")).alias("digest")] if digest else []
    shingled = source.select("doc_id", shingles(F.col("text"), width).alias("sh"), *more)
    schema = "doc_id long, n long, cls binary, bands array<long>" + (", digest binary" if digest else "")
    signed = _staged(shingled.mapInArrow(lambda it: _sign(it, bands, rows), schema), "minhash-signatures")
    # One value, so that both uses of it below need the same columns and Spark shuffles them once.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "n", "bands")).alias("first")
    members = signed.filter("n > 0").groupBy("cls").agg(first).select("cls", "first.doc_id", "first.n", "first.bands")
    placed = members.select("cls", "doc_id", "n", F.posexplode("bands").alias("band", "bucket"))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = _staged(placed.join(sizes, "bucket"), "minhash-buckets")
    # The sets of the classes that share a bucket with another one.
    wanted = _staged(buckets.groupBy("cls").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("n").alias("n"), F.sum("size").alias("score")), "minhash-shared")
    if exact:
        wanted = _staged(members.select("cls", "doc_id", "n").join(wanted.select("cls", "score"), "cls", "left"), "minhash-shared")
    # They grow with the corpus, so they are no side to broadcast.
    texts = _marked(source, "doc_id", wanted, "doc_id").join(wanted.select(F.col("cls").alias("want"), F.col("doc_id").alias("_id")).hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")))
    sets = texts.select("want", shingles(F.col("text"), width).alias("sh")).mapInArrow(_key_sets, "want binary, cls binary, sh array<long>")
    sets = _staged(sets.filter("cls = want").groupBy("cls").agg(F.any_value("sh").alias("sh")), "minhash-sets")

    scored = buckets.select("bucket", "cls", "n").join(wanted.select("cls", "score"), "cls")
    hubs = scored.groupBy("bucket").agg(F.max(F.struct("score", "cls", "n")).alias("hub"))
    star = scored.join(hubs, "bucket").filter(F.col("cls") != F.col("hub.cls")).groupBy("cls").agg(F.max("hub").alias("hub"), F.any_value("n").alias("n"))
    compared = _staged(star.filter(_possible("n", "hub.n", percent)).select(F.least("hub.cls", "cls").alias("a"), F.greatest("hub.cls", "cls").alias("b")).distinct(), "minhash-pairs")
    labels = _components(_confirmed(compared, sets, percent))

    if exact:
        labels = _merged_if_any(labels, _exact_links(sets, labels, percent))
    else:
        labels = _looked_again(buckets.select("bucket", "band", "cls", "n"), sets, labels, percent, bands, PAIR_ROWS if pair_rows is None else pair_rows)
    least = signed.groupBy("cls").agg(F.min("doc_id").alias("first")).join(labels, "cls")
    roots = least.groupBy("root").agg(F.min("first").alias("component"))
    component = labels.join(roots, "root").select("cls", "root", "component")
    same = signed.groupBy("cls").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("cls", "first")
    ids = component.join(same, "cls", "full_outer").select("cls", "root", F.coalesce("component", "first").alias("id"))
    return signed.drop("bands").join(ids, "cls", "left")


def _looked_again(buckets: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, bands: int, pair_rows: int) -> DataFrame:
    """labels after the links between classes of different components that share a bucket; a single group of bands has no sketch."""
    mixed = _staged(_mixed(buckets, labels).drop("root"), "minhash-open")
    alone = _unshared(_marked(sets, "cls", mixed, "cls"))
    rest = mixed.join(alone, F.xxhash64("cls") == F.col("cls_hash"), "left").withColumn("c", F.col("n") - F.coalesce("alone", F.lit(0)))
    rest = _staged(rest.filter(F.col("c") * 100 >= F.col("n") * percent).select("bucket", "band", "cls", "n", "c"), "minhash-open")
    groups, longs = range(0, bands, GROUP_BANDS), SKETCH_BITS // 64
    if len(groups) > 1:
        sketched = _marked(sets, "cls", rest, "cls").mapInArrow(lambda it: _sketch(it, len(groups)), "cls binary, sketch array<long>")
        sketched = _staged(sketched, "minhash-sketches")
    for k, first in enumerate(groups):
        group = rest.filter(F.col("band").between(first, first + GROUP_BANDS - 1)).drop("band")
        group = _staged(_mixed(group, labels), "minhash-open")
        if len(groups) == 1:
            links = _links_inside(group, _marked(sets, "cls", group, "cls"), percent)
        else:
            links = _links(group, sets, sketched.select("cls", F.slice("sketch", k * longs + 1, longs).alias("sketch")), percent, pair_rows)
        labels = _merged_if_any(labels, links)
    return labels


def _links(rest: DataFrame, sets: DataFrame, sketched: DataFrame, percent: int, pair_rows: int) -> DataFrame:
    """Links (a, b) of the buckets: in those of up to pair_rows rows by sketch first, in larger ones inside the join."""
    inside = lambda rows: _links_inside(rows, _marked(sets, "cls", rows, "cls").join(sketched, "cls"), percent)
    if not pair_rows:
        return inside(rest)
    large = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > pair_rows).select("bucket")
    few = rest.join(large, "bucket", "left_anti").join(sketched, "cls").withColumn("part", F.lit(0))
    pairs = _staged(_facing(few, few, percent).select(F.col("cls").alias("a"), F.col("cls_b").alias("b")).distinct(), "minhash-pairs")
    links = _confirmed(pairs, _marked(sets, "cls", pairs.select(F.explode(F.array("a", "b")).alias("cls")), "cls"), percent)
    many = _staged(rest.join(large, "bucket", "left_semi").select("bucket", "cls", "n", "c", "root"), "minhash-open")
    return links.unionByName(inside(many))


def _facing(rows: DataFrame, other: DataFrame, percent: int) -> DataFrame:
    """The pairs of a bucket and part that are of different components and can be similar enough by bound and, if there, sketch."""
    keys = ["bucket", "part"]
    other = other.select(*keys, *(F.col(k).alias(f"{k}_b") for k in other.columns if k not in keys))
    likely = _reaches(F.least("c", "c_b"), percent)
    if "sketch" in rows.columns:
        likely = likely & _alike(percent)
    return rows.join(other, keys).filter((F.col("cls") < F.col("cls_b")) & (F.col("root") != F.col("root_b")) & likely)


def _reaches(common: Column, percent: int) -> Column:
    return common * 100 >= (F.col("n") + F.col("n_b") - common) * percent


def _links_inside(rest: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the buckets, compared on the sets (cls, sh and maybe sketch) inside the join."""
    large = rest.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / SPLIT_ROWS).cast("int").alias("parts")).filter("parts > 1")
    if large.limit(1).count():
        rest = rest.join(large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        mine = rest.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
        rest = rest.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    else:
        mine = rest = rest.withColumn("part", F.lit(0))
    carried = lambda rows: rows.join(held, "cls").select("bucket", "part", "n", "c", "root", *held.columns)
    facing = _facing(carried(mine), carried(rest), percent)
    return facing.filter(_reaches(F.size(F.array_intersect("sh", "sh_b")), percent)).select(F.col("cls").alias("a"), F.col("cls_b").alias("b"))


def _merged_if_any(labels: DataFrame, links: DataFrame) -> DataFrame:
    links = _staged(links.groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one"), "minhash-links")
    return _merged(labels, links) if links.limit(1).count() else labels


def _exact_links(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All links (a, b) between classes of different components."""
    each = sets.select("cls", F.size("sh").alias("n"), F.explode("sh").alias("shingle"))
    shared = each.join(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "shingle")
    own = Window.partitionBy("cls")
    rank = F.row_number().over(own.orderBy("k", "shingle")) + F.col("n") - F.count(F.lit(1)).over(own)  # those of no other class come first
    prefix = shared.select("cls", "n", "shingle", rank.alias("rank")).filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    prefix = _staged(prefix.join(labels, "cls", "left").select("shingle", "cls", "n", F.coalesce("root", "cls").alias("root")), "minhash-prefix")
    other = prefix.select("shingle", F.col("cls").alias("cls_b"), F.col("n").alias("m"), F.col("root").alias("root_b"))
    met = prefix.join(other, "shingle").filter((F.col("cls") < F.col("cls_b")) & (F.col("root") != F.col("root_b")) & _possible("n", "m", percent))
    pairs = met.groupBy(F.col("cls").alias("a"), F.col("cls_b").alias("b")).agg(F.lit(1).alias("one")).drop("one")
    return _confirmed(_staged(pairs, "minhash-pairs"), sets, percent)


def _possible(n: str, m: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets that hold classes of more than one component, with their component as root."""
    labelled = rows.join(labels, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    several = labelled.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("bucket")
    return labelled.join(several, "bucket")


def _unshared(sets: DataFrame) -> DataFrame:
    """(cls_hash, alone): how many shingles of a class no other of these classes has."""
    each = sets.select(F.xxhash64("cls").alias("cls_hash"), F.explode("sh").alias("shingle"))
    single = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.any_value("cls_hash").alias("cls_hash")).filter("k = 1")
    return single.groupBy("cls_hash").agg(F.count(F.lit(1)).alias("alone"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after more links, contracted to the links between components."""
    of = lambda side: F.coalesce(F.col(f"root_{side}"), F.col(side))
    between = links.join(labels.select(F.col("cls").alias("a"), F.col("root").alias("root_a")), "a", "left").join(labels.select(F.col("cls").alias("b"), F.col("root").alias("root_b")), "b", "left")
    between = _staged(between.select(of("a").alias("a"), of("b").alias("b"), F.col("a").alias("x"), F.col("b").alias("y")), "minhash-between")
    roots = _components(between.select("a", "b").distinct())
    ends = between.select(F.col("a").alias("root"), F.col("x").alias("cls")).unionByName(between.select(F.col("b").alias("root"), F.col("y").alias("cls")))
    known = labels.unionByName(ends.select("cls", "root")).distinct()
    out = known.join(roots.select(F.col("cls").alias("root"), F.col("root").alias("new")), "root", "left").select("cls", F.coalesce("new", "root").alias("root"))
    return _staged(out, "minhash-labels")


def near_dedup_documents(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """Return doc_id, n_shingles, component_id, kept, one row for each document."""
    out = near_duplicates(docs, width, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies, all columns kept: of each group the document with the least doc_id stays.

    Null ids rank last; of different texts of that id in the group, one of the least class stays. Rows that are equal in id
    and text stay or go together, other rows of an id are judged by themselves. A text without shingles stays."""
    rows = _grouped(docs, width, percent, BANDS, ROWS, "doc_id", "text", digest=True, pair_rows=0).filter("n > 0")
    rows = rows.select("doc_id", "digest", "cls", F.coalesce("root", "cls").alias("group"))
    least = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "cls", "digest")).alias("least"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    gone = rows.join(least, "group").filter(~(F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("digest") == F.col("least.digest"))))
    gone = gone.select(F.col("doc_id").alias("__tarn_gone"), F.col("digest").alias("__tarn_digest")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__tarn_gone")) & (_digest(text_of()) == F.col("__tarn_digest"))
    return docs.join(gone, same, "left_anti")
