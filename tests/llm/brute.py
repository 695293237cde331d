"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import math
from collections import Counter
import re
import struct

import regex
import xxhash

from podium.llm import decontaminate, line_dedup, quality, simhash

SPACE = " \t\n\x0b\f\r"


def words(text):
    return [w for w in re.split(f"[{SPACE}]+", text or "") if w]


def xx(*values) -> int:
    """Spark's xxhash64 of strings and longs, as a signed long."""
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v)
        h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def shards(sizes, k):
    """Shard of each of the sizes, in order."""
    total, before, out = sum(sizes), 0, []
    for s in sizes:
        out.append((2 * before + s) * k // (2 * total) if total else 0)
        before += s
    return out


def base_rules(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    at: dict = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i:i + 8]), []).append(i)
    repeated = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    n = len(w)
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated),
            "base_failed": n < 20 or 100 * len(repeated) > 30 * n}


def grams(text):
    h = [xx(w) for w in regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+", text or "")]
    return h + [xx(a, b) for a, b in zip(h, h[1:])]


def quality_kept(docs, trusted):
    """{doc_id: (mean ratio in millionths, kept)} of [(doc_id, text)]."""
    raw, target = Counter(), Counter()
    for i, t in docs:
        raw.update(grams(t))
        if i in trusted:
            target.update(grams(t))
    scale = target.total() / max(1, raw.total())
    k = quality.PRIOR
    weight = {g: math.log((target[g] + k) / (n * scale + k)) * quality.MICRO for g, n in raw.items()}
    weight = {g: math.floor(abs(x) + 0.5) * (1 if x > 0 else -1) for g, x in weight.items()}  # half away from zero
    out = {}
    for i, t in docs:
        g = grams(t)
        mean = math.floor(sum(weight[b] for b in g) / len(g)) if g else None
        out[i] = (mean, not base_rules(t)["base_failed"] and mean is not None
                  and mean >= quality.THRESHOLD * quality.MICRO)
    return out


def drop_lines(docs, percent=line_dedup.RATIO_PERCENT, least=line_dedup.MIN_PAGES, copies_once=False):
    """Texts of [(host, text)] without boilerplate lines."""
    pages, total = {}, {}
    for place, (host, text) in enumerate(docs):
        if text is not None:
            page = text if copies_once else place
            total.setdefault(host, set()).add(page)
            for line in text.split("\n"):
                if words(line):
                    pages.setdefault((host, line), set()).add(page)
    bad = {k for k, v in pages.items() if len(v) >= least and 100 * len(v) > percent * len(total[k[0]])}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (h, x) not in bad) for h, t in docs]


def fingerprint(text):
    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    s = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(ids, prints, distance=simhash.DISTANCE):
    """Smallest id reachable over prints within the distance (ids may repeat, None is last)."""
    n = len(ids)
    of = list(range(n))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                of[find(i)] = find(j)
    best: dict = {}
    for i in range(n):
        if ids[i] is not None:
            r = find(i)
            best[r] = min(best.get(r, ids[i]), ids[i])
    return [best.get(find(i)) for i in range(n)]


def tokens(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def leak(text, items):
    """(smallest item, most tokens that agree) over [(item_id, text)], or None."""
    d, found = tokens(text), []
    for item, body in items:
        b = tokens(body)
        width = min(decontaminate.OVERLAP, len(b))
        for mask in decontaminate.MASKS:
            ones = [i for i, c in enumerate(mask) if c == "1"]
            for q in range(len(d) - len(mask) + 1):
                for p in range(len(b) - len(mask) + 1):
                    if all(d[q + o] == b[p + o] for o in ones):
                        for s in range(max(0, p + len(mask) - width), min(p, len(b) - width) + 1):
                            n = sum(0 <= q - p + s + j < len(d) and d[q - p + s + j] == b[s + j] for j in range(width))
                            if 100 * n >= decontaminate.SIMILARITY * width:
                                found.append((item, n))
    return (min(i for i, _ in found), max(n for _, n in found)) if found else None


def repeats(docs, length):
    """{row: (spans, kept)} of [(doc_id, bytes)]; None is larger than any id."""
    key = [(i is None, i or 0) for i, _ in docs]
    first: dict = {}
    for k, (_, b) in zip(key, docs):
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            first[w] = min(first.get(w, k), k)
    out = []
    for k, (_, b) in zip(key, docs):
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < k:
                gone[p:p + length] = [True] * length
        spans, at = [], 0
        while at < len(b):
            end = at
            while end < len(b) and gone[end]:
                end += 1
            if end > at:
                spans.append((at, end))
            at = end + 1
        out.append((spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out
