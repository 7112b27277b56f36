"""Token counts: pieces are counted once per distinct pre-token and summed by per-document frequencies.

A pre-token is a run of spaces with what follows up to the next space. The model must have no piece with a space after
another character (checked when it is loaded), so no merge crosses that border, and a text's tokens are those of its
pre-tokens. A pre-token is written without the first space of its run, which is the dummy prefix of the first one.

1. The distinct pre-tokens of each task, with the number of documents that have them, are merged over the corpus, and the
   library counts the pieces of each distinct pre-token once.
2. Pre-tokens in more than 1 of HOT_SHARE of all (document, pre-token) pairs are at most HOT_SHARE in number, whatever the
   corpus; with keys of at most KEY_CHARS characters they are a table of proven size, which is broadcast. In the second
   pass each text sums those at once and emits only the others as (text, pre-token, frequency).
   A text goes by a 64-bit hash, whatever its id, and copies that a task has met lately are not emitted again: the row of
   the sum, which each emission has once, says by how many to divide. That row's key is 16 bytes of a digest. Where texts
   of two digests share a hash, they are told from the others by it and counted apart, each as a whole.
3. These rows are joined to the counts and summed per text. No key of that join has more than its 1 / HOT_SHARE share of
   the rows. The sums are then joined to the documents, narrow rows of id, hash and size.
Ids live no longer than a batch of distinct pre-tokens in the library's worker; only counts go on.

Longer pre-tokens go by a 16-byte digest as their key. Defined results: a null text is empty and has 0 tokens. Repeated
rows each get a result, and any number of rows may share an id or have none. Very long texts are counted whole, and so is a
long text without spaces. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table, text_of

HOT_SHARE = 600_000
KEY_CHARS = 48
OVER_LIMIT = 4096
#: Distinct pre-tokens a task holds before it passes them on.
HELD = 300_000
#: Digests of texts that a task remembers having emitted.
REMEMBERED = 200_000
#: Bytes of text that a task turns into Python objects at once.
CHUNK = 1_000_000
_RUN = re.compile(" +[^ ]*")
_SPACE = "▁"
# How the keys of long pre-tokens and of sums start. Both have KEY_CHARS + 1 characters, more than a pre-token that is its own key.
_LONG, _SUM = "\x00", "\x01"


def pre_tokens(text: str) -> list[str]:
    if _SPACE in text:
        text = text.replace(_SPACE, " ")
    if not text:
        return []
    if "  " in text or text[0] == " ":
        return [m[1:] for m in _RUN.findall(" " + text)]
    return text.split(" ")


def _padded(start: str, digest) -> str:
    return start + digest.hexdigest() + start * (KEY_CHARS - 32)


def key_of(pre_token: str) -> str:
    if len(pre_token) <= KEY_CHARS:
        return pre_token
    return _padded(_LONG, hashlib.blake2b(pre_token.encode(), digest_size=16))


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    inner = [p for p in map(model.id_to_piece, range(model.vocab_size())) if _SPACE in p.lstrip(_SPACE)]
    if inner:
        raise ValueError(f"the model has pieces that go over a space, such as {inner[0]!r}")
    return model


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with some `size` bytes of text each."""
    if not len(column):
        return
    part = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
    yield from zip(edges[:-1], edges[1:], strict=True)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, pre_token, documents); what comes again and again is held on, so that it is passed on less often."""
    seen: Counter[str] = Counter()

    def out(some: Counter[str]) -> pa.RecordBatch:
        long = [k if len(k) > KEY_CHARS else None for k in some]  # the others are their own key
        return pa.RecordBatch.from_arrays([pa.array(map(key_of, some), pa.string()), pa.array(long, pa.string()), pa.array(some.values(), pa.int64())], names=["key", "pre_token", "documents"])

    for batch in batches:
        for a, b in chunks(batch.column(0)):
            for text in batch.column(0).slice(a, b - a).to_pylist():
                seen.update(set(pre_tokens(text)))
                if len(seen) > HELD:
                    often = Counter({k: n for k, n in seen.items() if n > 1})
                    if len(often) > HELD // 2:
                        often = Counter()
                    yield out(Counter({k: n for k, n in seen.items() if k not in often}))
                    seen = often
    if seen:
        yield out(seen)


def _count_pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = load(path)
    for batch in batches:
        texts = [k if p is None else p for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        counts = [len(x) if t else 1 for t, x in zip(texts, model.encode(texts, num_threads=1), strict=True)]  # "" is a single space
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["key", "documents", "pieces"])


def _sum_hot(batches: Iterator[pa.RecordBatch], hot: Broadcast) -> Iterator[pa.RecordBatch]:
    known, met = hot.value, set()
    schema = pa.schema([("digest", pa.int64()), ("key", pa.string()), ("n", pa.int64())])
    for batch in batches:
        for a, b in chunks(batch.column(1)):
            digests, keys, counts = [], [], []
            for digest, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                whole = _padded(_SUM, hashlib.blake2b(text.encode(), digest_size=16))
                if whole in met:
                    continue
                if len(met) >= REMEMBERED:
                    met.clear()
                met.add(whole)
                total, rest = 0, []
                for token in pre_tokens(text):
                    n = known.get(token)
                    if n is None:
                        rest.append(token)
                    else:
                        total += n
                cold = Counter(rest)
                # The key of the sum itself matches no pre-token, and is dealt evenly.
                keys.append(whole)
                keys.extend(map(key_of, cold))
                counts.append(total)
                counts.extend(cold.values())
                digests.extend([digest] * (len(cold) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), pa.array(keys, pa.string()), pa.array(counts, pa.int64())], schema=schema)


def _count_whole(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = load(path)
    for batch in batches:
        counts = [sum(len(model.encode(p)) if p else 1 for p in pre_tokens(t)) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = OVER_LIMIT, digest: Column | None = None) -> DataFrame:
    """Return doc_id, n_bytes, n_tokens, over_limit, one row for each document.

    digest: a long for each text, by default a hash of 64 bits; texts that share one are still counted right."""
    spark, path = docs.sparkSession, path or model_file()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), (F.xxhash64(text_of(text_col)) if digest is None else digest).alias("digest"))
    distinct = rows.select("text").mapInArrow(_distinct, "key string, pre_token string, documents long").groupBy("key").agg(F.any_value("pre_token").alias("pre_token"), F.sum("documents").alias("documents"))
    pieces = stage_table(distinct.mapInArrow(lambda it: _count_pieces(it, path), "key string, documents long, pieces long"), "token-pieces")
    pairs = pieces.agg(F.sum("documents")).first()[0] or 0
    # At most HOT_SHARE rows pass, as their documents add up to no more than all pairs.
    in_tier = (F.col("documents") * HOT_SHARE > pairs) & ~F.startswith("key", F.lit(_LONG))
    hot = pieces.filter(in_tier).select("key", "pieces").toArrow()
    held = spark.sparkContext.broadcast(dict(zip(hot["key"].to_pylist(), hot["pieces"].to_pylist(), strict=True)))
    parts = rows.select("digest", "text").mapInArrow(lambda it: _sum_hot(it, held), "digest long, key string, n long")
    joined = parts.join(pieces.filter(~in_tier).select("key", "pieces"), "key", "left")
    mark = F.when(F.startswith("key", F.lit(_SUM)) & (F.length("key") > KEY_CHARS), F.xxhash64("key"))
    sums = joined.groupBy("digest").agg(F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("total"), F.count(mark).alias("times"), F.min(mark).alias("low"), F.max(mark).alias("high"))
    sums = stage_table(sums.select("digest", F.expr("total div times").alias("n_tokens"), (F.col("low") != F.col("high")).alias("shared")), "token-sums")
    sizes = rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    out = sizes.join(sums.filter("NOT shared"), "digest").select("doc_id", "n_bytes", "n_tokens")
    if sums.filter("shared").limit(1).count():
        alike = rows.join(sums.filter("shared").select("digest"), "digest", "left_semi").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
        out = out.unionByName(alike.mapInArrow(lambda it: _count_whole(it, path), "doc_id long, n_bytes long, n_tokens long"))
    return out.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
