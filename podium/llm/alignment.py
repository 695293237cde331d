"""Cross-tokenizer alignment (operator 13).

Two tokenizers cut the same bytes; where tokens of both end, the two tokens are
linked.  Each link is then weighed against all links of the corpus:

1. A task encodes texts and, for every ``CHUNK_BYTES`` of them, sorts its
   (pair, document) records side-major -- by the id of tokenizer B, then that of A --
   and radix-partitions them by B's id into zstd runs: one file, with a segment of
   pairs and their counts, and one of records, for each radix.
2. For each radix a k-way merge counts every pair: a heap holds the last pair of
   each run's current block, and what is not beyond the smallest is complete.  As
   all pairs of a B id come side by side, its highest count is known when the next
   id begins.  More than ``FAN_IN`` runs are first merged in groups.  A pair comes
   once a run, however often it occurs, so a frequent pair is not a hot key.
3. Every file is read once more beside the counts, radix by radix in the same
   order, and what each pair gives to its documents is added up.  Documents never
   leave their file, so no key of theirs is shuffled.

Files go to the shared folder; their names are in a written index, so a lost
executor costs the tasks it was running.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialize, open_store, scratch_path

#: text bytes of one file of runs
CHUNK_BYTES = 8 << 20
#: parts of B's ids; a power of two
RADIX = 64
#: runs merged at once
FAN_IN = 256
#: pairs of a block of a run
PAIRS_PER_BLOCK = 1 << 14
#: words a worker remembers
WORDS = 300_000
#: texts that are not cut into words: characters beyond these, or white space side by side or at an end
ODD = re.compile(r"[^\n\x20-\x7e\xa1-\xff]|[ \n][ \n]|^[ \n]|[ \n]$|^$")
WORD = re.compile(r" [^ \n]+|\n[^ \n]+")
SEGMENT = "<4q"

_ALIGNERS: dict[tuple[str, str], "Aligner"] = {}


def byte_decoder() -> dict[str, int]:
    """Bytes of the characters that a byte-level vocabulary is spelt in: visible Latin-1
    characters stand for themselves, the other bytes for characters from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in visible}
    rest = [b for b in range(256) if b not in set(visible)]
    return out | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Tokens of both tokenizers over the bytes of space + text, and their links.

    Neither tokenizer joins bytes across a single space or line feed that a visible
    character follows (B's vocabulary is checked for that), so texts of common
    characters are cut there and the alignment of a word is remembered; other texts
    are encoded whole.
    """

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        vocabulary = self.a.get_vocab()
        decoder = byte_decoder()
        self.a_bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(decoder[c] for c in token) if all(c in decoder for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        # B may be cut before a space, and around a line feed that is a token of its own
        feed = self.b.encode("\n")
        self.lead = len(feed) - 1
        self.by_word = (not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
                        and bool(feed) and self.b_bytes[feed[-1]] == b"\n")
        # tokens that begin a word of a text that is cut
        self.a_first = np.array([x[:1] in (b" ", b"\n") for x in self.a_bytes], bool)
        self.b_first = np.array([x[:1] in (b" ", b"\n") for x in self.b_bytes], bool)
        # decimal ids, left-aligned, with room for what follows them
        top = max(len(self.a_bytes), len(self.b_bytes), 1)
        self.digits = np.array([str(i) for i in range(top)], dtype=bytes)
        self.width = self.digits.itemsize + 1
        self.n_digits = np.char.str_len(self.digits).astype(np.int64)
        self.digits = np.pad(self.digits.view(np.uint8).reshape(top, -1), ((0, 0), (0, 1)))
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.texts: list[str] = []
        # tokens of A (-1: not spelt back) and of B of each word; its links are links[begin[i]:begin[i + 1]]
        self.n_a, self.n_b = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.begin, self.links = np.zeros(1024, np.int64), np.zeros(4096, np.uint64)

    def _ids(self, texts: list[str], spaced: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's ids of ``spaced`` and B's of ``texts``."""
        a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        return a, self.b.encode(texts, num_threads=1)

    @staticmethod
    def spelt(a: list[int], b: list[int], cut_a: list[int], cut_b: list[int]) -> str:
        out, i, j = [], 0, 0
        for x, y in zip(cut_a, cut_b):
            out.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        return ";".join(out)

    def _at_once(self, words: list[str]):
        """The tokens of words that begin with a space or a line feed, encoded end to end, and
        how many each has; None if they don't spell the words back one by one."""
        text = "".join(words)
        fed = text[0] == "\n"
        (a,), (b,) = self._ids([text if fed else text[1:]], [text])
        b, data = b[self.lead if fed else 0:], text.encode()
        if b"".join([self.a_bytes[i] for i in a]) != data or b"".join([self.b_bytes[i] for i in b]) != data:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        cut_a, cut_b = np.flatnonzero(self.a_first[a]), np.flatnonzero(self.b_first[b])
        if len(cut_a) != len(words) or len(cut_b) != len(words):
            return None
        return a, b, np.diff(np.append(cut_a, len(a))), np.diff(np.append(cut_b, len(b)))

    def _one_by_one(self, words: list[str]):
        """As ``_at_once``, with -1 for the tokens of A of a word that isn't spelt back."""
        all_a, all_b, n_a, n_b = [], [], [], []
        for w in words:
            (a,), (b,) = self._ids([w if w[0] == "\n" else w[1:]], [w])
            b = b[self.lead if w[0] == "\n" else 0:]
            right = b"".join([self.a_bytes[i] for i in a]) == w.encode() == b"".join([self.b_bytes[i] for i in b])
            all_a += a if right else []
            all_b += b if right else []
            n_a.append(len(a) if right else -1)
            n_b.append(len(b) if right else 0)
        return np.array(all_a, np.int64), np.array(all_b, np.int64), np.array(n_a, np.int64), np.array(n_b, np.int64)

    def _learn(self, words: list[str]) -> None:
        a, b, n_a, n_b = self._at_once(words) or self._one_by_one(words)
        first, last = len(self.texts), len(self.texts) + len(words)
        # the words' tokens cover the same bytes end to end: where both end is a link
        ends_a, ends_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        met = np.searchsorted(ends_b, ends_a)
        link_a = np.flatnonzero(ends_b[np.minimum(met, len(b) - 1)] == ends_a) if len(b) else np.zeros(0, np.int64)
        link_b = met[link_a]
        of_word = np.cumsum(np.maximum(n_a, 0))  # tokens of A up to each word's end
        n_links = np.diff(np.searchsorted(link_a, of_word), prepend=0)
        spelt, ends = self._spell(a, b, link_a, link_b)
        stop = np.concatenate([[0], ends])[np.cumsum(n_links)].tolist()
        start = [0, *stop[:-1]]
        self.texts += [spelt[i:j - 1] for i, j in zip(start, stop)]
        self.places.update(zip(words, range(first, last)))
        while last >= len(self.n_a):
            self.n_a, self.n_b, self.begin = (np.concatenate([x, np.zeros_like(x)]) for x in (self.n_a, self.n_b, self.begin))
        self.n_a[first:last], self.n_b[first:last] = n_a, n_b
        at = int(self.begin[first])
        self.begin[first + 1:last + 1] = at + np.cumsum(n_links)
        while at + len(link_a) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.links[at:at + len(link_a)] = b[link_b].astype(np.uint64) << np.uint64(32) | a[link_a].astype(np.uint64)

    def _spell(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[str, np.ndarray]:
        """Groups that end at the tokens cut_a and cut_b, as ``a1,a2|b1;`` end to end, and
        where each group's text ends."""
        if not len(cut_a):
            return "", np.zeros(0, np.int64)
        group_a, group_b = np.searchsorted(cut_a, np.arange(len(a))), np.searchsorted(cut_b, np.arange(len(b)))
        before_b = np.concatenate([[0], cut_b + 1])
        ids, after = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        place_a, place_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + cut_a[group_b] + 1
        ids[place_a], ids[place_b] = a, b
        after[place_a[cut_a]], after[place_b[cut_b]] = ord("|"), ord(";")
        rows = self.digits[ids]
        n = self.n_digits[ids]
        rows[np.arange(len(ids)), n] = after
        used = np.arange(self.width) <= n[:, None]
        return rows[used].tobytes().decode(), np.cumsum(n + 1)[place_b[cut_b]]

    def _whole(self, text: str):
        (a,), (b,) = self._ids([text], [" " + text])
        data = (" " + text).encode("utf-8", "surrogatepass")
        if b"".join([self.a_bytes[i] for i in a]) != data or b"".join([self.b_bytes[i] for i in b]) != data:
            return None
        ends_a, ends_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        _, at_a, at_b = np.intersect1d(ends_a, ends_b, return_indices=True)
        a_ids, b_ids = np.array(a, np.uint64), np.array(b, np.uint64)
        spelt = self.spelt(a, b, (at_a + 1).tolist(), (at_b + 1).tolist())
        return len(a), len(b), len(at_a), spelt, b_ids[at_b] << np.uint64(32) | a_ids[at_a]

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray] | None]:
        """For each text its tokens by A and by B, its groups, them spelt out, and its
        links (B's id, then A's, in 64 bits); None if it has no tokens."""
        cut: list = [None] * len(texts)
        for i, text in enumerate(texts):
            if text and self.by_word and not ODD.search(text):
                cut[i] = WORD.findall(" " + text)
        used = set().union(*(words for words in cut if words))
        new = used - self.places.keys()
        if len(self.places) + len(new) > WORDS:
            self._forget()
            new = used
        new = sorted(new)
        for i in range(0, len(new), 4096):
            self._learn(new[i:i + 4096])
        for text, words in zip(texts, cut):
            if words is None:
                yield self._whole(text) if text else None
                continue
            places = [self.places[w] for w in words]
            at = np.array(places, np.int64)
            n_a = self.n_a[at]
            if (n_a < 0).any():
                yield None
                continue
            begin = self.begin[at]
            n = self.begin[at + 1] - begin
            ends = np.cumsum(n)
            links = self.links[np.repeat(begin - (ends - n), n) + np.arange(int(ends[-1]))]
            yield (int(n_a.sum()), int(self.n_b[at].sum()), len(links), ";".join([self.texts[i] for i in places]), links)


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker and pair of files."""
    key = a_path, b_path
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(a_path, b_path)
    return _ALIGNERS[key]


def _press(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd frame; keys in order are kept as differences."""
    import zstandard

    head = struct.pack("<q", len(arrays)) + b"".join(struct.pack("<q2s", len(x), x.dtype.str[1:].encode()) for x in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(x.tobytes() for x in arrays))


def _unpress(frame: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(frame)
    (n,), at, kinds = struct.unpack_from("<q", data), 8, []
    for _ in range(n):
        kinds.append(struct.unpack_from("<q2s", data, at))
        at += 10
    out = []
    for size, kind in kinds:
        x = np.frombuffer(data, "<" + kind.decode(), size, at)
        at += x.nbytes
        out.append(x)
    return out


def _blocks(keys: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
    """Frames of sorted pairs and their counts, each after its length."""
    for i in range(0, len(keys), PAIRS_PER_BLOCK):
        k = keys[i:i + PAIRS_PER_BLOCK]
        frame = _press(np.diff(k, prepend=np.uint64(0)), counts[i:i + PAIRS_PER_BLOCK])
        yield struct.pack("<q", len(frame)) + frame


class RunReader:
    """The blocks of a run, one at a time."""

    def __init__(self, path: str, begin: int, size: int):
        self.path, self.at, self.end = path, begin, begin + size
        self.keys, self.rest = np.zeros(0, np.uint64), []

    def next(self) -> bool:
        if self.at >= self.end:
            return False
        store, inner = open_store(self.path)
        with store.open_input_file(inner) as f:
            (n,) = struct.unpack("<q", f.read_at(8, self.at))
            steps, *self.rest = _unpress(f.read_at(n, self.at + 8))
        self.at += 8 + n
        self.keys = np.cumsum(steps, dtype=np.uint64)
        return True

    def take(self, last: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """What the current block has up to the key ``last``."""
        n = int(np.searchsorted(self.keys, np.uint64(last), side="right"))
        got = self.keys[:n], [x[:n] for x in self.rest]
        self.keys, self.rest = self.keys[n:], [x[n:] for x in self.rest]
        return got


def merged(runs: list[RunReader]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of the runs once, in order, with its count over all: a heap of the
    last keys of the runs' current blocks tells up to where all are complete."""
    heap = []
    for i, run in enumerate(runs):
        if run.next():
            heapq.heappush(heap, (int(run.keys[-1]), i))
    while heap:
        last = heap[0][0]
        parts = [runs[i].take(last) for _, i in heap]
        while heap and heap[0][0] == last:
            _, i = heapq.heappop(heap)
            if runs[i].next():
                heapq.heappush(heap, (int(runs[i].keys[-1]), i))
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate([c[0] for _, c in parts])[order]
        starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - np.uint64(1) if keys[0] else np.uint64(1)))
        yield keys[starts], np.add.reduceat(counts, starts)


def with_best(stream: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs, counts, and whether a count is the highest of its B id: the pairs of an
    id wait until the next begins."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def judged(k, c):
        first = np.flatnonzero(np.diff(k >> np.uint64(32), prepend=(k[0] >> np.uint64(32)) + np.uint64(1)))
        top = np.repeat(np.maximum.reduceat(c, first), np.diff(np.append(first, len(k))))
        return k, c, (c == top).astype(np.uint8)

    for k, c in stream:
        keys, counts = np.concatenate([keys, k]), np.concatenate([counts, c])
        cut = int(np.searchsorted(keys >> np.uint64(32), keys[-1] >> np.uint64(32)))
        if cut:
            yield judged(keys[:cut], counts[:cut])
            keys, counts = keys[cut:], counts[cut:]
    if len(keys):
        yield judged(keys, counts)


def _write(folder: str, parts: Iterator[bytes]) -> tuple[str, int]:
    store, inner = open_store(folder)
    name = f"{uuid.uuid4().hex}.run"
    store.create_dir(inner, recursive=True)
    size = 0
    with store.open_output_stream(f"{inner}/{name}") as f:
        for p in parts:
            f.write(p)
            size += len(p)
    return f"{folder}/{name}", size


def _spill(folder: str, ids: list, found: list, radix: int) -> list[tuple]:
    """Write a file of runs; (path, radix, begin, size) of its segments of pairs, and, as
    radix -1, of its table of segments and documents."""
    docs = np.repeat(np.arange(len(found), dtype=np.uint32), [len(x[4]) if x else 0 for x in found])
    keys = np.concatenate([x[4] for x in found if x] or [np.zeros(0, np.uint64)])
    part = (keys >> np.uint64(32)) & np.uint64(radix - 1)
    order = np.lexsort((docs, keys, part))
    keys, docs, part = keys[order], docs[order], part[order]
    starts = np.searchsorted(part, np.arange(radix + 1, dtype=np.uint64))
    body, segments, at = [], [], 0
    for r in range(radix):
        k, d = keys[starts[r]:starts[r + 1]], docs[starts[r]:starts[r + 1]]
        if not len(k):
            segments.append((0, 0, 0, 0))
            continue
        # a record is a pair in a document, with how often; a pair's records are side by side
        record = np.flatnonzero((np.diff(k, prepend=~k[:1]) != 0) | (np.diff(d.astype(np.int64), prepend=-1) != 0))
        times = np.diff(np.append(record, len(k)))
        rk, rd = k[record], d[record]
        pair = np.flatnonzero(np.diff(rk, prepend=~rk[:1]))
        pairs = b"".join(_blocks(rk[pair], np.add.reduceat(times, pair)))
        records = _press(rk[pair], np.diff(np.append(pair, len(rk))).astype(np.uint32), rd, times.astype(np.uint32))
        segments.append((at, len(pairs), at + len(pairs), len(records)))
        body += [pairs, records]
        at += len(pairs) + len(records)
    sink = pa.BufferOutputStream()
    table = pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), *[pa.array([x[i] if x else 0 for x in found], pa.int64()) for i in range(3)],
         pa.array([x[3] if x else "" for x in found], pa.string())],
        ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"])
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(table)
    tail = b"".join(struct.pack(SEGMENT, *s) for s in segments) + sink.getvalue().to_pybytes()
    path, _ = _write(folder, iter([*body, tail]))
    rows = [(path, r, s[0], s[1]) for r, s in enumerate(segments) if s[1]]
    return [*rows, (path, -1, at, len(tail))]


_INDEX = "path string, radix int, begin long, size long"


def _index(rows: list[tuple]) -> pa.RecordBatch:
    path, radix, begin, size = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(radix, pa.int32()),
                                       pa.array(begin, pa.int64()), pa.array(size, pa.int64())],
                                      ["path", "radix", "begin", "size"])


def spilled(docs: DataFrame, a_path: str, b_path: str, folder: str, doc_id: str, text: str, radix: int,
            chunk_bytes: int) -> DataFrame:
    """The index of the runs of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        held, ids, size = [], [], 0
        for batch in batches:
            keys, texts = (c.to_pylist() for c in batch.columns)
            for i in range(0, len(texts), 256):
                for j, x in enumerate(tool.align(texts[i:i + 256])):
                    # the spelt groups are long: only their digest waits
                    held.append(x and (*x[:3], hashlib.sha256(x[3].encode()).hexdigest(), x[4]))
                    ids.append(keys[i + j])
                    size += len(texts[i + j] or "") + 16
                    if size >= chunk_bytes:
                        yield _index(_spill(folder, ids, held, radix))
                        held, ids, size = [], [], 0
        if held:
            yield _index(_spill(folder, ids, held, radix))

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, _INDEX)


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[RunReader]]]:
    """Rows (radix, part, path, begin, size) in order: the runs of each radix and part."""
    key, runs = None, []
    for batch in batches:
        for r, part, path, begin, size in zip(*(c.to_pylist() for c in batch.columns)):
            if (r, part) != key:
                if runs:
                    yield key, runs
                key, runs = (r, part), []
            runs.append(RunReader(path, begin, size))
    if runs:
        yield key, runs


def _merger(folder: str, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (r, _), runs in _runs_of(batches):
            if last:
                parts = (struct.pack("<q", len(f)) + f for k, c, top in with_best(merged(runs))
                         for i in range(0, len(k), PAIRS_PER_BLOCK)
                         for f in [_press(np.diff(k[i:i + PAIRS_PER_BLOCK], prepend=np.uint64(0)),
                                          c[i:i + PAIRS_PER_BLOCK], top[i:i + PAIRS_PER_BLOCK])])
            else:
                parts = (f for k, c in merged(runs) for f in _blocks(k, c))
            path, size = _write(folder, parts)
            yield _index([(path, r, 0, size)])

    return run


def pair_counts(index: DataFrame, folder: str, n_files: int, radix: int, fan_in: int = FAN_IN) -> list[tuple]:
    """(path, radix, begin, size) of the counts of each radix, at most one row for each:
    every pair once, side-major, with its count and whether it is its B id's highest."""
    runs = index.where("radix >= 0")

    def merge(rows: DataFrame, parts: int, last: bool) -> DataFrame:
        rows = rows.select("radix", F.pmod(F.xxhash64("path", "begin"), F.lit(parts)).cast("int").alias("part"),
                           "path", "begin", "size")
        keys = ["radix"] if parts == 1 else ["radix", "part"]
        # a number of tasks, as an index row stands for a run; each meets whole (radix, part) groups
        dealt = rows.repartitionByRange(radix * parts, *keys).sortWithinPartitions("radix", "part")
        return materialize(map_batches(dealt, _merger(folder, last), _INDEX), "merged")

    while n_files > fan_in:
        n_files = -(-n_files // fan_in)
        runs = merge(runs, n_files, False)
    return [tuple(r) for r in merge(runs, 1, True).collect()]


def _weigher(tables: list[tuple], radix: int):
    """Rows (path, begin, size) of files: their documents with what the counts give them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = []
        for batch in batches:
            for path, begin, size in zip(*(c.to_pylist() for c in batch.columns)):
                store, inner = open_store(path)
                with store.open_input_file(inner) as f:
                    tail = f.read_at(size, begin)
                segments = [struct.unpack_from(SEGMENT, tail, struct.calcsize(SEGMENT) * r) for r in range(radix)]
                docs = pa.ipc.open_stream(tail[struct.calcsize(SEGMENT) * radix:]).read_all()
                files.append((store, inner, segments, docs, np.zeros((2, len(docs)), np.int64)))
        for path, r, begin, size in sorted(tables, key=lambda t: t[1]):
            held = []
            for store, inner, segments, _, sums in files:
                _, _, at, n = segments[r]
                if n:
                    with store.open_input_file(inner) as f:
                        keys, spread, doc, times = _unpress(f.read_at(n, at))
                    held.append((keys, spread, doc, times, sums, np.zeros((2, len(keys)), np.int64)))
            places = [0] * len(held)
            table = RunReader(path, begin, size)
            while held and table.next():
                counts, top = table.rest
                for i, (keys, *_, got) in enumerate(held):
                    z = int(np.searchsorted(keys, table.keys[-1], side="right"))
                    at = np.searchsorted(table.keys, keys[places[i]:z])
                    got[0, places[i]:z], got[1, places[i]:z] = counts[at], top[at]
                    places[i] = z
            for keys, spread, doc, times, sums, got in held:
                weight = times.astype(np.int64)
                np.add.at(sums[0], doc, weight * np.repeat(got[1], spread))
                np.add.at(sums[1], doc, weight * np.repeat(got[0], spread))
        for *_, docs, sums in files:
            for b in docs.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1])).to_batches(
                    max_chunksize=10_000):
                yield b.select(["doc_id", "n_a", "n_b", "n_groups", "n_best", "count_sum", "groups_sha256"])

    return run


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", *, radix: int = RADIX,
          chunk_bytes: int = CHUNK_BYTES, fan_in: int = FAN_IN, files_per_task: int = 32) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a and n_b (tokens), n_groups (parts between
    places where tokens of both end), n_links (pairs of tokens that end together: one a
    group), n_best (links whose pair is linked most often of all of its B id), count_sum
    (over links, how often the pair is linked in all texts), groups_sha256.

    A is a byte-level ``tokenizers`` file and reads space + text; B is a ``sentencepiece``
    model that adds the space itself; both paths must be open to every executor.  A text
    that is null or empty, or that either does not spell back byte for byte, has no
    tokens: zeros and an empty string.  Repeated rows count as often as they come; null
    ids are kept; an empty table gives no rows; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    folder = scratch_path(spark, "runs")
    index = materialize(spilled(docs, a_path, b_path, folder, doc_id, text, radix, chunk_bytes), "runs_index")
    files = index.where("radix < 0").select("path", "begin", "size")
    n_files = files.count()
    tables = pair_counts(index, folder, n_files, radix, fan_in) if n_files else []
    tasks = max(-(-n_files // files_per_task), min(n_files, int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    out = map_batches(files.repartition(tasks), _weigher(tables, radix),
                      "doc_id long, n_a long, n_b long, n_groups long, n_best long, count_sum long, groups_sha256 string")
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum",
                      "groups_sha256")
