"""License scan (operator 4).

Templates are winnowed: of every WINDOW consecutive word trigrams the one of
smallest hash is kept, with its places, in an inverted index; of a template of
under WINNOWED words all are, and where the edits that COVERAGE allows can touch
every trigram, shorter grams.  Every gram of every document is looked up in it
(all documents of a batch at once, in numpy).
Hits of a template near one diagonal make a candidate, which is settled by a
sequence alignment in a band around the diagonal: it gives the template words
matched in order and the span of the document they cover.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .license_texts import TEMPLATES

GRAM = 3
WINDOW = 4
#: words of the shortest template that is winnowed
WINNOWED = 20
#: words the alignment may stray from the diagonal (half its words for a short template)
BAND = 12
#: least share of the template's words, per cent
COVERAGE = 80
MATCH, MISMATCH, GAP = 2, -1, -1

_words = re.compile(r"[^\W_]+").findall


def words(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    found = _words(text)
    return " ".join(found).lower().split(" ") if found else []


def gram_of(n_words: int, coverage: int) -> int:
    """Words of the grams of a template: GRAM, or the longest run that stays whole
    wherever the edits are that the coverage allows."""
    agree = max(1, -(-n_words * coverage // 100))
    return min(GRAM, max(1, -(-agree // (n_words - agree + 1)))) if n_words > agree else min(GRAM, max(1, n_words))


class TemplateIndex:
    """Grams of the templates, winnowed for the long ones: (template, place) by number of words and gram."""

    def __init__(self, templates: Mapping[str, str], window: int = WINDOW, coverage: int = COVERAGE):
        self.names = sorted(templates)
        tokens = [words(templates[n]) for n in self.names]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in tokens for w in t}))}
        self.base = len(self.vocabulary) + 1
        self.templates = [[self.vocabulary[w] for w in t] for t in tokens]
        self.postings: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, ids in enumerate(self.templates):
            size = gram_of(len(ids), coverage)
            keys = self.keys(np.array(ids, np.int64), size)
            step = window if len(ids) >= WINNOWED else 1
            mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)
            kept = {max(range(i, min(i + step, len(keys))), key=lambda j: (-int(mixed[j]), j))
                    for i in range(max(1, len(keys) - step + 1))} if len(keys) else set()
            for place in sorted(kept):
                self.postings.setdefault(size, defaultdict(list))[int(keys[place])].append((t, place))
        self.wanted = {size: np.array(sorted(found), np.int64) for size, found in self.postings.items()}

    def keys(self, ids: np.ndarray, size: int = GRAM) -> np.ndarray:
        """One number for each gram; -1 where a word is in no template."""
        if len(ids) < size:
            return np.empty(0, np.int64)
        parts = [ids[i:len(ids) - size + 1 + i] for i in range(size)]
        key = np.zeros(len(parts[0]), np.int64)
        for p in parts:
            key = key * self.base + p
        return np.where(np.logical_and.reduce([p >= 0 for p in parts]), key, -1)

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Places that begin a gram of the index."""
        places = [np.empty(0, np.int64)]
        for size, wanted in self.wanted.items():
            keys = self.keys(ids, size)
            if len(keys):
                at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                places.append(np.flatnonzero(wanted[at] == keys))
        return np.unique(np.concatenate(places))

    def at(self, ids: list[int], place: int) -> Iterator[tuple[int, int]]:
        """(template, place) of the grams that begin at a place of a document."""
        for size, postings in self.postings.items():
            gram, key = ids[place:place + size], 0
            if len(gram) == size and min(gram) >= 0:
                for w in gram:
                    key = key * self.base + w
                yield from postings.get(key, ())


def band_of(template: list[int]) -> int:
    """Short templates get a narrow band, so that neighbouring copies stay apart."""
    return min(BAND, max(1, len(template) // 2))


def align(template: list[int], doc: list[int], diagonal: int, band: int) -> tuple[int, int, int]:
    """(words matched, first, end) of the best alignment of a template with the
    words of ``doc`` within ``band`` of the diagonal (doc place - template place);
    free at the ends, the earliest and shortest of equal ones."""
    width = 2 * band + 1
    empty = (0, 0, -1, -1)  # score, matched, first, end
    best, above = empty, [empty] * (width + 2)
    for i, word in enumerate(template):
        row = [empty] * (width + 2)
        for c in range(1, width + 1):
            j = i + diagonal + c - 1 - band
            if not 0 <= j < len(doc):
                continue
            s, m, a, e = above[c]  # a pair of words: same diagonal
            if doc[j] == word:
                found = (s + MATCH, m + 1, a if m else j, j + 1)
            else:
                found = (s + MISMATCH, m, a, e)
            for s, m, a, e in (above[c + 1], row[c - 1]):  # a template word, a document word left out
                if s + GAP > found[0]:
                    found = (s + GAP, m, a, e)
            if found[0] <= 0:
                found = empty
            row[c] = found
            if found[0] > best[0]:
                best = found
        above = row
    return best[1], best[2], best[3]


def scan(ids: list[int], hits: list[int], index: TemplateIndex, coverage: int = COVERAGE) -> list[tuple]:
    """(template, matched, first word, end word) of the templates found in one
    document, none overlapping: the most words matched first, so that an edited text wins
    over an intact notice inside it, then the best covered, then by name."""
    by_template: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for place in hits:
        for t, at in index.at(ids, place):
            by_template[t].append((place - at, place))
    found = set()
    for t, places in by_template.items():
        last, band = None, band_of(index.templates[t])
        for diagonal in sorted({d for d, _ in places}):
            # one alignment covers the diagonals half a band around it
            if last is not None and diagonal - last <= band // 2:
                continue
            last = diagonal
            lo = max(0, diagonal - band)
            matched, first, end = align(index.templates[t], ids[lo:diagonal + len(index.templates[t]) + band],
                                        diagonal - lo, band)
            if matched * 100 >= coverage * len(index.templates[t]):
                found.add((t, matched, lo + first, lo + end))
    chosen: list[tuple] = []
    for t, matched, first, end in sorted(found, key=lambda x: (-x[1], -x[1] / len(index.templates[x[0]]), x[0], x[2])):
        if all(end <= f or e <= first for _, _, f, e in chosen):
            chosen.append((t, matched, first, end))
    return sorted(chosen, key=lambda x: x[2])


def find_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, doc_id: str = "doc_id",
                  text: str = "text", coverage: int = COVERAGE) -> DataFrame:
    """(doc_id, license, start, end, matched, length): a row for each template found
    in a text; start and end in characters, matched and length in template words.

    Case, punctuation and white space don't count.  ``templates`` (name: text) is
    held by the caller and sent to every task.  Null and empty texts, and an empty
    table, give no rows; repeated rows give their rows again; a null doc_id is kept.
    """
    templates = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates, coverage=coverage)
        known = index.vocabulary.get
        gap = [-1] * GRAM
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                ids: list[int] = []
                starts = []
                for t in texts:
                    starts.append(len(ids))
                    ids += [known(w, -1) for w in words(t or "")]
                    ids += gap
                hits = index.hits(np.array(ids, np.int64))
                if not len(hits):
                    continue
                owner = np.searchsorted(starts, hits, side="right") - 1
                rows = []
                for d in np.unique(owner).tolist():
                    end = starts[d + 1] if d + 1 < len(starts) else len(ids)
                    found = scan(ids[starts[d]:end - GRAM], (hits[owner == d] - starts[d]).tolist(), index, coverage)
                    if found:
                        spans = [m.span() for m in re.finditer(r"[^\W_]+", texts[d])]
                        rows += [(keys[d], index.names[t], spans[a][0], spans[e - 1][1], m, len(index.templates[t]))
                                 for t, m, a, e in found]
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[0], pa.int64()), pa.array(c[1]), *(pa.array(x, pa.int64()) for x in c[2:])],
                        ["doc_id", "license", "start", "end", "matched", "length"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run,
                       "doc_id long, license string, start long, end long, matched long, length long")
