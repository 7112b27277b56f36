"""Plain Python versions of the operators, for small fixtures."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingle_set(text, width):
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def components(rows, width, percent):
    """doc -> least doc reachable, over (doc, text) with distinct docs."""
    sets = {d: shingle_set(t, width) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(sets)
    for k, a in enumerate(docs):
        for b in docs[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}, sets


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    counts = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if counts[tuple(words[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def base_spans(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


def jump(key, n):
    """The published jump consistent hash of a 64-bit key."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def url_rule(host, path, rules):
    best = None
    for verdict, text in rules:
        h, slash, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(text) > len(best[1])):
            best = (verdict, text)
    return best


ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "folded32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


def battery(run):
    """(encoding, letters, chi-squared, z of runs, z of serial correlation)."""
    bare = re.sub("[-_/]", "", run)
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", bare):
        kind, body = "hex", bare.lower()
    elif re.fullmatch("[A-Z2-7]+", bare) and len(re.findall("[2-7]", bare)) > 1:
        kind, body = "base32", bare
    elif re.fullmatch("[A-Z2-7]+|[a-z2-7]+", bare):
        kind, body = "folded32", bare.upper()
    elif re.fullmatch("[A-Z0-9]+|[a-z0-9]+", bare):
        kind, body = "base36", bare.upper()
    else:
        kind, body = "base64", run.replace("-", "+").replace("_", "/")
    letters, n = ALPHABETS[kind], len(body)
    k, v = len(letters), [letters.index(c) + 1 for c in body]
    chi = sum((body.count(c) - n / k) ** 2 / (n / k) for c in letters)
    high = [x > k / 2 for x in v]
    both = 2 * sum(high) * (n - sum(high))
    changes = sum(a != b for a, b in zip(high, high[1:], strict=False))
    runs = (changes - both / n) / (both * (both - n) / (n * n * (n - 1))) ** 0.5 if both > n else 9.0
    mean = sum(v) / n
    spread = sum((x - mean) ** 2 for x in v)
    serial = (sum((a - mean) * (b - mean) for a, b in zip(v, v[1:], strict=False)) / spread + 1 / n) * n**0.5 if spread > 1e-9 else 9.0
    return kind, n, chi, runs, serial
