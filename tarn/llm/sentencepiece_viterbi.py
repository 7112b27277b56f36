"""SentencePiece encoding and decoding: a batched numpy Viterbi over the words of many texts.

Words of equal length advance together. At each place the hashes of all substrings that end there probe the sorted hashes
of the pieces, and a vectorised maximum over the pieces that may stand there stores the backpointer. For a model of the BPE
kind a path of greatest score is not what the model means, so the score of a step is 0 if the piece can follow the piece
that the best path ends with, and minus infinity if not; of all paths just one then has a score above minus infinity, the
encoding that merging by priority gives. A piece can follow another if undoing the merges of both along their common border, latest
first, never meets two neighbours that would have merged earlier (`_follows`).

A long word is cut into windows of WINDOW characters, STRIDE apart, which advance together like other words of one length.
Where the windows of two neighbours have a border in common, and the pieces on either side of it can follow one another, all
neighbours in the joined encoding can, so it is that of the whole; a word with windows that have no such seam is merged by priority.

Words are runs of spaces with what follows; each distinct word is encoded once per worker while it is held (at most HELD
words), and the ids of a text are gathered. Characters that are no piece become their bytes. Runs of two or more spaces
are pieces of equal score, merged from the left after everything else, and are treated by `_spaces`.

Decoding joins the bytes of the pieces by one gather. decode(encode(text)) is the text, with U+2581 read as a space.

Defined results: null and empty texts have no ids; their decoded form is empty. Repeated rows get equal results. Long
texts are encoded whole, and a long run without spaces takes time in proportion to its length, and where windows have no seam
in n log n. A model that is not of the BPE kind is refused. Extra columns are passed on
by `encode` unless named token_ids, which is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .token_counts import chunks, load, model_file, pre_tokens

HELD = 400_000
#: Chunks in which a pre-token must have come to be held on when the others are dropped.
OFTEN = 2
#: Characters of text that are worked on at once.
CHUNK = 2_000_000
#: Places of words that advance together.
PLACES = 200_000
#: Windows of long words start STRIDE characters apart, a multiple of most lengths of pieces, and overlap by OVERLAP.
STRIDE, OVERLAP = 240, 64
#: Words of more than SHORT characters are grouped by multiples of FILL.
SHORT, FILL = 24, 32
_NO_PIECE = "\uffff"
_SPACE = "▁"
_B = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)
_TABLE_BITS = 20
_KNOWN_BITS = 20


class Sorted:
    """Sorted keys with values. A table by the upper bits of a key's hash names the key to compare with; the few keys that
    share a place with another one are found by bisection."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        assert len(np.unique(self.keys)) == len(keys), "two keys have one hash"
        place = self._place(self.keys)
        self.table = np.full(1 << _TABLE_BITS, -1, np.int32)
        self.table[place] = np.arange(len(keys))
        self.shared = np.zeros(1 << _TABLE_BITS, bool)
        self.shared[place[np.bincount(place, minlength=1 << _TABLE_BITS)[place] > 1]] = True

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _M) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        place = self._place(keys)
        index = self.table[place]
        maybe = np.flatnonzero(index >= 0)
        if len(maybe):
            probe, index = keys[maybe], index[maybe]
            out[maybe] = np.where(self.keys[index] == probe, self.values[index], -1)
            again = maybe[self.shared[place[maybe]]]
            if len(again):
                probe = keys[again]
                at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
                out[again] = np.where(self.keys[at] == probe, self.values[at], -1)
        return out


def _merge(text: str, score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """Merging by priority, with the pair of the last merge."""
    parts = list(text)
    after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
    heap: list = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (s := score.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (-s, i, parts[i], parts[j]))

    for i in range(len(parts)):
        offer(i)
    last = None
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j < 0 or parts[j] != b:
            continue
        last, parts[i], parts[j] = (a, b), a + b, ""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [p for p in parts if p], last


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (raw[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if raw[at - 1] < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a serialized protocol buffer, as (number, value)."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if wire == 2 else (8 if wire == 1 else 4, at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def model_type(serialized: bytes) -> int:
    """The type of a model file: 1 unigram (the default), 2 BPE, 3 word, 4 character."""
    spec = next((v for k, v in _fields(serialized) if k == 2), b"")
    return next((v for k, v in _fields(spec) if k == 3), 1)


class Vocabulary:
    """The tables of a model, of a size that only depends on its vocabulary; made once and sent to the workers."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            kind = model_type(f.read())
        if kind != 2:
            raise ValueError(f"{path} is no BPE model: its type is {kind}")
        model = load(path)
        n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        score = {names[i]: model.get_score(i) for i in normal}
        self.n, self.unknown = n, n
        self.space_scores = {p: s for p, s in score.items() if p.strip(_SPACE) == ""}
        self.ids = {names[i]: i for i in normal}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        words = {p: s for p, s in score.items() if len(p) == 1 or p not in self.space_scores}
        assert _NO_PIECE not in words
        self.scores = words
        self.characters = np.array([*(len(p) for p in names), 1], np.int64)  # of pieces of a word; the last one is unknown
        self.rank = np.full(n + 1, -1, np.int64)  # when a piece is made; characters are there from the start
        self.left, self.right = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32)
        order = {p: k for k, p in enumerate(sorted((p for p in words if len(p) > 1), key=lambda p: -words[p]))}
        usable = []
        for p in words:
            made, last = _merge(p, words)
            if made == [p]:
                i = self.ids[p]
                usable.append(p)
                if last:
                    self.rank[i], self.left[i], self.right[i] = order[p], self.ids[last[0]], self.ids[last[1]]
        self.longest = max(map(len, usable))
        self.power = np.array([pow(int(_B), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        self.pieces = Sorted(np.array([_hash(p) for p in usable], np.uint64), np.array([self.ids[p] for p in usable], np.int32))
        pairs = {(self.ids[p[:k]], self.ids[p[k:]]): order[p] for p in words for k in range(1, len(p)) if p[:k] in words and p[k:] in words}
        self.pairs = Sorted(np.array([a * (n + 1) + b for a, b in pairs], np.uint64), np.array(list(pairs.values()), np.int32))
        #: Two characters that stand side by side in some piece; between others there is always a border.
        self.inside = {p[k : k + 2] for p in usable for k in range(len(p) - 1)}
        raw = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([self.byte_ids.index(i)]) if model.is_byte(i) else names[i].replace(_SPACE, " ").encode() for i in range(n)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_B) + ord(c) + 1) % (1 << 64)
    return h


class Known:
    """The answers of `_follows` for the pairs that came last, at a place that the pair decides."""

    def __init__(self) -> None:
        self.pair, self.ok = np.full(1 << _KNOWN_BITS, -1, np.int64), np.zeros(1 << _KNOWN_BITS, bool)

    def follows(self, v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a.astype(np.int64) * (v.n + 1) + b
        place = ((pair.astype(np.uint64) * _M) >> np.uint64(64 - _KNOWN_BITS)).astype(np.int64)
        ok = self.ok[place]
        new = np.flatnonzero(self.pair[place] != pair)
        if len(new):
            ok[new] = _follows(v, a[new], b[new])
            self.pair[place[new]], self.ok[place[new]] = pair[new], ok[new]
        return ok


def _follows(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether piece b can follow piece a, for many pairs at once."""
    ok = np.ones(len(a), bool)
    left = np.flatnonzero((a != v.unknown) & (b != v.unknown))
    a, b = a[left].astype(np.int64), b[left].astype(np.int64)
    limit = np.full(len(left), np.iinfo(np.int64).max)  # twice the time up to which both stand; odd if b goes first at a tie
    while len(left):
        made = v.pairs.find((a * (v.n + 1) + b).astype(np.uint64)).astype(np.int64)
        merged = (made >= 0) & (2 * made < limit)
        ok[left[merged]] = False
        ra, rb = v.rank[a], v.rank[b]
        go = ~merged & ((ra >= 0) | (rb >= 0))
        left, a, b, ra, rb = left[go], a[go], b[go], ra[go], rb[go]
        undo = ra > rb
        limit = np.where(undo, 2 * ra, 2 * rb + 1)
        a, b = np.where(undo, v.right[a], a), np.where(undo, b, v.left[b])
    return ok


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._spaces_held: dict[int, list[int]] = {}
        self.known = Known()
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.size, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.int32), 0
        self.met = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keep only the pre-tokens that came in several chunks."""
        often = self.met[: len(self.index)] >= OFTEN
        kept = [p for p, keep in zip(self.index, often.tolist(), strict=True) if keep]
        start, size = self.start[: len(often)][often], self.size[: len(often)][often]
        ends = np.cumsum(size.astype(np.int64))
        flat = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)]
        self.reset()
        if len(kept) < HELD // 2:
            self._add_many(kept, flat, size)

    def _spaces(self, n: int) -> list[int]:
        if n not in self._spaces_held:
            made, _ = _merge(_SPACE * n, self.v.space_scores)
            self._spaces_held[n] = [self.v.ids[p] for p in made]
        return self._spaces_held[n]

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of one length: the ids of all, and how many each has. Unknown characters have the id `unknown`."""
        v, n, size = self.v, len(words), len(words[0])
        chars = np.array(words, dtype=f"<U{size}").view(np.uint32).reshape(n, size).astype(np.uint64)
        with np.errstate(over="ignore"):
            prefix = np.zeros((size + 1, n), np.uint64)
            for i in range(size):
                prefix[i + 1] = prefix[i] * _B + chars[:, i] + np.uint64(1)
            found = []  # found[k - 1][start]: the pieces of k characters from there
            for k in range(1, min(size, v.longest) + 1):
                keys = prefix[k:] - prefix[: size - k + 1] * v.power[k]
                found.append(v.pieces.find(keys.ravel()).reshape(keys.shape))
        found[0][found[0] < 0] = v.unknown
        last, back = np.full((size + 1, n), -1, np.int32), np.zeros((size + 1, n), np.int32)
        for end in range(1, size + 1):
            who, what, long, prior = [], [], [], []
            for k in range(1, min(end, v.longest) + 1):
                piece = found[k - 1][end - k]
                at = np.flatnonzero(piece >= 0) if k == end else np.flatnonzero((piece >= 0) & (last[end - k] >= 0))
                if len(at):
                    who.append(at)
                    what.append(piece[at])
                    long.append(np.full(len(at), k, np.int32))
                    prior.append(np.full(len(at), v.unknown, np.int32) if k == end else last[end - k][at])
            who, what, long, prior = map(np.concatenate, (who, what, long, prior))
            fits = self.known.follows(v, prior, what)
            who, what, long = who[fits], what[fits], long[fits]
            np.maximum.at(back[end], who, long)
            best = back[end][who] == long
            last[end][who[best]] = what[best]
        # Back from the end of each word; ids come out last first.
        rows, at, out_row, out_id = np.arange(n), np.full(n, size), [], []
        while len(rows):
            out_row.append(rows)
            out_id.append(last[at, rows])
            at = at - back[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        row, ids = np.concatenate(out_row[::-1]), np.concatenate(out_id[::-1])
        order = np.argsort(row, kind="stable")
        return ids[order], np.bincount(row, minlength=n)

    def _cut(self, word: str) -> list[str]:
        """A long word at the borders that no piece goes over."""
        inside, parts, at = self.v.inside, [], 0
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in inside:
                parts.append(word[at:k])
                at = k
        return [*parts, word[at:]]

    def _long(self, words: list[str]) -> dict[str, np.ndarray]:
        """The ids of words of more than a window."""
        spans = {w: [(at, min(at + STRIDE + OVERLAP, len(w))) for at in range(0, max(1, len(w) - OVERLAP), STRIDE)] for w in words}
        done = self._by_length(list({w[a:b] for w, some in spans.items() for a, b in some}))
        out = {}
        for word, windows in spans.items():
            parts = [done[word[a:b]][0][slice(*done[word[a:b]][1:])] for a, b in windows]
            out[word] = self._joined(word, windows, parts)
        return out

    def _joined(self, word: str, windows: list[tuple[int, int]], parts: list[np.ndarray]) -> np.ndarray:
        borders = [a + np.concatenate([[0], np.cumsum(self.v.characters[ids])]) for (a, _), ids in zip(windows, parts, strict=True)]
        starts, ends = [0], []
        for left, right, before, after in zip(parts[:-1], parts[1:], borders[:-1], borders[1:], strict=True):
            _, i, j = np.intersect1d(before, after, assume_unique=True, return_indices=True)
            inside = (i > 0) & (j < len(right))
            i, j = i[inside], j[inside]
            good = np.flatnonzero(self.known.follows(self.v, left[i - 1], right[j])) if len(i) else i
            if not len(good):
                return self._by_priority(word)
            ends.append(int(i[good[len(good) // 2]]))
            starts.append(int(j[good[len(good) // 2]]))
        return np.concatenate([ids[a:b] for ids, a, b in zip(parts, starts, [*ends, None], strict=True)])

    def _by_priority(self, text: str) -> np.ndarray:
        made, _ = _merge(text, self.v.scores)
        return np.array([self.v.ids.get(p, self.v.unknown) if p in self.v.scores else self.v.unknown for p in made], np.int32)

    def _by_length(self, words: list[str]) -> dict[str, tuple[np.ndarray, int, int]]:
        """(ids, from, to) of each word. Words of more than SHORT characters are filled up with characters that are no piece, each
        an unknown one at the end, so that words of nearly one length advance together."""
        groups: dict[int, list[str]] = defaultdict(list)
        for w in words:
            groups[len(w) if len(w) <= SHORT else -(-len(w) // FILL) * FILL].append(w)
        out: dict[str, tuple[np.ndarray, int, int]] = {}
        for size, group in groups.items():
            step = max(1, PLACES // size)
            for at in range(0, len(group), step):
                some = group[at : at + step]
                filled = np.array([size - len(w) for w in some])
                ids, counts = self.viterbi([w + _NO_PIECE * n for w, n in zip(some, filled.tolist(), strict=True)])
                ends = np.cumsum(counts)
                out.update(zip(some, zip([ids] * len(some), (ends - counts).tolist(), (ends - filled).tolist(), strict=True), strict=True))
        return out

    def _add(self, pre_token: str, ids: np.ndarray) -> None:
        k, n = len(self.index), len(ids)
        if k == len(self.start):
            self.start, self.size = np.resize(self.start, 2 * k), np.resize(self.size, 2 * k)
        while self.used + n > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + n] = ids
        self.start[k], self.size[k] = self.used, n
        self.index[pre_token] = k
        self.used += n

    def _add_many(self, pre_tokens: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        k, n = len(self.index), len(pre_tokens)
        while k + n > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k : k + n] = self.used + np.cumsum(counts) - counts
        self.size[k : k + n] = counts
        self.index.update(zip(pre_tokens, range(k, k + n), strict=True))
        self.used += len(ids)

    def learn(self, pre_tokens: list[str]) -> None:
        """Encode distinct pre-tokens that are not held yet: short words behind one space at once, all others singly."""
        groups: dict[int, list[str]] = defaultdict(list)
        odd = []
        for p in pre_tokens:
            if 0 < len(p) < 24 and p[0] != " ":
                groups[len(p)].append(p)
            else:
                odd.append(p)
        for size, group in groups.items():
            step = max(1, PLACES // (size + 1))
            for at in range(0, len(group), step):
                some = group[at : at + step]
                ids, counts = self.viterbi([_SPACE + p for p in some])
                strange = np.flatnonzero(ids == self.v.unknown)
                if len(strange):
                    ends = np.cumsum(counts)
                    for row in np.unique(np.searchsorted(ends, strange, "right")).tolist():
                        self._add(some[row], self._with_bytes(_SPACE + some[row], ids[ends[row] - counts[row] : ends[row]]))
                    plain = np.ones(len(some), bool)
                    plain[np.unique(np.searchsorted(ends, strange, "right"))] = False
                    some, ids, counts = [p for p, ok in zip(some, plain.tolist(), strict=True) if ok], ids[np.repeat(plain, counts)], counts[plain]
                self._add_many(some, ids, counts)
        self._learn_odd(odd)

    def _learn_odd(self, pre_tokens: list[str]) -> None:
        v, space = self.v, self.v.ids[_SPACE]
        parts: dict[str, list[str]] = {}
        for p in pre_tokens:
            w = p.lstrip(" ")
            if w:
                w = _SPACE + w
                parts[p] = [w] if len(w) <= 24 else self._cut(w)
        every = {w for ws in parts.values() for w in ws}
        long = [w for w in every if len(w) > STRIDE + OVERLAP]
        done = self._by_length(list(every.difference(long)))
        done.update((w, (ids, 0, len(ids))) for w, ids in self._long(long).items())
        for p in pre_tokens:
            run = len(p) - len(p.lstrip(" ")) + 1
            if p not in parts:
                self._add(p, np.array(self._spaces(run), np.int32))
                continue
            ids = [done[w][0][done[w][1] : done[w][2]] for w in parts[p]]
            ids = ids[0] if len(ids) == 1 else np.concatenate(ids)
            if (ids == v.unknown).any():
                ids = self._with_bytes("".join(parts[p]), ids)
            if run > 1:
                alone = ids[0] == space
                ids = np.concatenate([np.array(self._spaces(run if alone else run - 1), np.int32), ids[1:] if alone else ids])
            self._add(p, ids)

    def _with_bytes(self, word: str, ids: np.ndarray) -> np.ndarray:
        """Each unknown character by its bytes. The pieces say how far each id goes."""
        out, at = [], 0
        for i in ids.tolist():
            if i == self.v.unknown:
                out += [self.v.byte_ids[b] for b in word[at].encode()]
                at += 1
            else:
                out.append(i)
                a = self.v.raw_start[i]
                at += len(self.v.raw[a : a + self.v.raw_size[i]].tobytes().decode())
        return np.array(out, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each text has."""
        if len(self.index) > HELD:
            self.forget()
        tokens = [pre_tokens(t) for t in texts]
        flat = [t for ts in tokens for t in ts]
        new = set(flat).difference(self.index)
        if new:
            self.learn(list(new))
        which = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        self.met = np.concatenate([self.met, np.zeros(len(self.index) - len(self.met), np.int64)])
        self.met[np.unique(which)] += 1
        size, start = self.size[which].astype(np.int64), self.start[which]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)]
        of = np.cumsum([0, *map(len, tokens)])
        total = np.concatenate([[0], ends])
        return ids, np.diff(total[of])


def decode_ids(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts of ids, counts[k] of them for text k."""
    size = v.raw_size[ids]
    ends = np.cumsum(size)
    raw = v.raw[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(v.raw_start[ids] - (ends - size), size)].tobytes()
    cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [t[1:] if (t := raw[a:b].decode("utf-8", "replace"))[:1] == " " else t for a, b in zip(cut[:-1], cut[1:], strict=True)]


#: The encoder of this worker, held over its tasks; one at a time.
_held: list[Encoder] = []


def _encoder(vocabulary: Vocabulary) -> Encoder:
    if not _held or _held[0].v is not vocabulary:
        _held[:] = [Encoder(vocabulary)]
    return _held[0]


def _encode_batches(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(sent.value)
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("__tarn_text"))
        for a, b in chunks(column, CHUNK):
            ids, counts = encoder.encode([t or "" for t in column.slice(a, b - a).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
            rest = batch.slice(a, b - a).drop_columns(["__tarn_text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, lists], names=[*rest.schema.names, "token_ids"])


def _decode_batches(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("__tarn_ids"))
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        texts = decode_ids(sent.value, lists.flatten().to_numpy(zero_copy_only=False), counts)
        rest = batch.drop_columns(["__tarn_ids"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(texts, pa.string())], names=[*rest.schema.names, "decoded"])


def _round_trip(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Encoding and decoding in one worker."""
    v = sent.value
    encoder = _encoder(v)
    for batch in batches:
        for a, b in chunks(batch.column(1), CHUNK):
            texts = batch.column(1).slice(a, b - a).to_pylist()
            ids, counts = encoder.encode(texts)
            back = decode_ids(v, ids, counts)
            raw, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(counts)).tolist()
            digests = [zlib.crc32(raw[end - 4 * n : end]) for end, n in zip(ends, counts.tolist(), strict=True)]
            same = [x == y.replace(_SPACE, " ") for x, y in zip(back, texts, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(digests, pa.int64()), pa.array(same), lists], names=["doc_id", "n_tokens", "ids_crc32", "round_trip", "token_ids"])


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with token_ids array<int>."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(path or model_file()))
    rows = docs.select(*[c for c in (docs.columns if keep is None else keep) if c != "token_ids"], F.col(text_col).alias("__tarn_text"))
    schema = rows.drop("__tarn_text").schema.add("token_ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(lambda it: _encode_batches(it, sent), schema)


def decode(rows: DataFrame, ids_col: str = "token_ids", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """rows (or its columns `keep`) with decoded string."""
    sent = rows.sparkSession.sparkContext.broadcast(Vocabulary(path or model_file()))
    rows = rows.select(*[c for c in (rows.columns if keep is None else keep) if c != "decoded"], F.col(ids_col).alias("__tarn_ids"))
    schema = rows.drop("__tarn_ids").schema.add("decoded", T.StringType())
    return rows.mapInArrow(lambda it: _decode_batches(it, sent), schema)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Return doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit words), round_trip (decoding gives the text), token_ids."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(path or model_file()))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda it: _round_trip(it, sent), "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, token_ids array<int>")
