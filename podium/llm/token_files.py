"""Token ids in compressed binary files (operator 6).

1. Every text is encoded; ids are written with their counts unknown yet.
2. Global counts of ids (one row per id at most) give the canonical
   length-limited Huffman code.
3. Documents are coded on their own, dealt into files by bounds on doc_id, and
   written in ascending doc_id order: code lengths, data, then a footer with
   each document's place and a bit-offset checkpoint every 512 ids.
4. A manifest row per file gives the global start of its first id.

Reading decodes each file's blocks independently from their checkpoints.
"""

from __future__ import annotations

import json
import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize, open_store, scratch_path
from .huffman import BLOCK, Codec, code_lengths

END_ID = 0
#: ids per file; larger on a large cluster
IDS_PER_FILE = 4_000_000
#: words whose ids a worker remembers (some 50 bytes each)
WORDS = 2_000_000
#: bytes of text encoded together
TEXT_BYTES = 12 << 20
MAGIC = b"PODTOK01"
#: texts that are not cut into words before they reach the tokenizer: with characters
#: beyond these, or white space side by side or at an end
ODD = r"[^\n\x20-\x7e\x{a1}-\x{ff}]|[ \n][ \n]|^[ \n]|[ \n]$|^$"

_ENCODERS: dict[tuple[str, bool], "Encoder"] = {}


def _places(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... n of them, for each."""
    ends = np.cumsum(n)
    return np.repeat(begin - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Ids of whole texts by a tokenizers file.

    A byte-level tokenizer splits a text before every space that a visible
    character follows, and around a single line feed, and encodes the parts on
    their own.  So a text of common characters and single white space is cut
    there into words, and the ids of a word are asked of the library once and
    remembered (WORDS at most, then forgotten), in Arrow and numpy arrays.  Texts
    with any other character or with white space side by side go to the library
    whole, as do texts that hold an added token's content and all texts of a
    tokenizer of another kind.

    ``added_tokens``: the special tokens among the added ones are found in a text, as
    the library does by default; else their content is read as plain text.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        spec = json.loads(self.tokenizer.to_str())
        split = spec["pre_tokenizer"] or {}
        self.by_word = (split.get("type") == "ByteLevel" and split.get("use_regex") and not split["add_prefix_space"]
                        and spec["normalizer"] is None and spec["post_processor"] is None)
        found = [t["content"] for t in spec["added_tokens"] if t["content"] and (added_tokens or not t["special"])]
        # words side by side could spell a content with white space
        self.by_word = self.by_word and not any(re.search(r"\s", c) for c in found)
        self.odd = "|".join([ODD, *map(re.escape, found)])
        vocabulary = self.tokenizer.get_vocab()
        # ids of tokens that begin with a space or a line feed: the first of a word
        self.first = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.first[[i for token, i in vocabulary.items() if token[0] in "\u0120\u010a"]] = True
        self._forget()

    def _forget(self) -> None:
        # the ids of words[n] are flat[begin[n]:begin[n + 1]]
        self.words = pa.array([], pa.large_string())
        self.flat, self.begin = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def _room(self, end: int) -> None:
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of words, by the library."""
        spaced = [w if w[0] == "\n" else " " + w for w in words]
        ids = np.frombuffer(self._whole(["".join(spaced)])[0], "<u4")
        cuts = np.flatnonzero(self.first[ids])
        if len(cuts) == len(words) and cuts[0] == 0:
            return ids, np.diff(np.append(cuts, len(ids)))
        each = self._whole(spaced)  # a vocabulary whose tokens don't tell where a word begins
        return np.frombuffer(b"".join(each), "<u4"), np.array([len(e) // 4 for e in each])

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words in the store, the missing ones learnt."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if len(self.words) + len(missing) > WORDS:
            self._forget()
            missing = np.arange(len(words))
        if len(missing):
            new = words.take(pa.array(missing))
            texts = new.to_pylist()
            learnt = [self._learn(texts[i:i + 4096]) for i in range(0, len(texts), 4096)]
            ids, n = (np.concatenate(x) for x in zip(*learnt))
            known = len(self.words)
            start = int(self.begin[known])
            self._room(start + len(ids))
            self.flat[start:start + len(ids)] = ids
            while known + len(n) >= len(self.begin):
                self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.begin[known + 1:known + len(n) + 1] = start + np.cumsum(n)
            at[missing] = known + np.arange(len(n))
            self.words = pa.concat_arrays([self.words, new])
        return at

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (unsigned 32-bit; null: none)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = np.zeros(len(texts), bool)
        if self.by_word:
            plain = ~pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False).astype(bool)
        whole = iter(self._whole(texts.filter(pa.array(~plain)).to_pylist()))
        of_words = iter(self._by_words(texts.filter(pa.array(plain))))
        return [next(of_words) if p else np.frombuffer(next(whole), "<u4") for p in plain]

    def _by_words(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        first = np.asarray(split.offsets)[:-1].astype(np.int64)
        coded = split.values.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        numbers = self._numbers(coded.dictionary)
        # a text's first word has no space before it: its ids are its own, kept behind the store's for now
        heads = self._whole(pc.take(split.values, pa.array(first)).to_pylist())
        head_n = np.array([len(h) // 4 for h in heads], np.int64)
        end = int(self.begin[len(self.words)])
        self._room(end + int(head_n.sum()))
        self.flat[end:end + int(head_n.sum())] = np.frombuffer(b"".join(heads), "<u4")
        begin = self.begin[numbers][code]
        n = (self.begin[numbers + 1] - self.begin[numbers])[code]
        begin[first] = end + np.cumsum(head_n) - head_n
        n[first] = head_n
        ends = np.cumsum(n)
        return np.split(self.flat[_places(begin, n)], ends[np.append(first[1:], len(n)) - 1][:-1])


def encoder(path: str, added_tokens: bool = False) -> Encoder:
    """One per worker, file and kind."""
    key = path, added_tokens
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, added_tokens)
    return _ENCODERS[key]


def token_ids(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
              end_id: int = END_ID, added_tokens: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of every whole text (null: empty) with the end id.  ids
    is a byte that tells their width, 2 or 4, and the ids in so many
    little-endian bytes.  ``tokenizer`` is a path that every executor can open;
    ``added_tokens`` as in ``Encoder``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = encoder(tokenizer, added_tokens), np.array([end_id], np.uint32)
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            part = size // TEXT_BYTES
            starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            for a, z in zip(starts, [*starts[1:], batch.num_rows]):
                b = batch.slice(a, z - a)
                ids = [np.append(x, end) for x in e.encode(b.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([_pack(x) for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run,
                       "doc_id long, n_tokens long, ids binary")


def _pack(ids: np.ndarray) -> bytes:
    """The width the ids need, and the ids."""
    return b"\x02" + ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.uint32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for b in (batch.slice(i, 64) for batch in batches for i in range(0, batch.num_rows, 64)):
        c = np.bincount(np.concatenate([_unpack(x) for x in b.column(0).to_pylist()]))
        if len(c) > len(total):
            total = np.append(total, np.zeros(len(c) - len(total), np.int64))
        total[: len(c)] += c
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])


def _coder(lengths: bytes, bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, ends = Codec(np.frombuffer(zlib.decompress(lengths), np.uint8)), np.array(bounds, np.int64)
        for b in (batch.slice(i, 512) for batch in batches for i in range(0, batch.num_rows, 512)):
            ids, keys = b.column(2).to_pylist(), b.column(0).to_pylist()
            coded = [c for i in range(0, len(ids), 64) for c in codec.encode_many([_unpack(x) for x in ids[i:i + 64]])]
            part = [0 if k is None else int(np.searchsorted(ends, k)) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), b.column(0), b.column(1), pa.array([c for c, _ in coded], pa.binary()),
                 pa.array([k.astype("<u4").tobytes() for _, k in coded], pa.binary())],
                ["part", "doc_id", "n_tokens", "code", "checkpoints"])

    return run


def _file_writer(folder: str, lengths: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, name, docs, marks, at = None, None, None, [], [], 0

        def close():
            table = np.array([(k or 0, k is not None, n, o, m) for k, n, o, m in docs], "<i8").tobytes()
            footer = zlib.compress(table, 1), zlib.compress(b"".join(marks), 1)
            out.write(b"".join(footer) + struct.pack("<QQQ", len(docs), *map(len, footer)) + MAGIC)
            out.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(docs)], pa.int64()),
                 pa.array([sum(d[1] for d in docs)], pa.int64())], ["part", "path", "n_docs", "n_tokens"])

        for b in batches:
            for p, k, n, code, marked in zip(*(c.to_pylist() for c in b.columns)):
                if p != part:
                    if out is not None:
                        yield close()
                    fs, path = open_store(folder)
                    fs.create_dir(path, recursive=True)
                    part, name, docs, marks, at = p, f"ids-{p:06d}-{uuid.uuid4().hex}.bin", [], [], 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(MAGIC + struct.pack("<Q", len(lengths)) + lengths)
                out.write(code)
                docs.append((k, n, at, len(marked) // 4))
                marks.append(marked)
                at += len(code)
        if out is not None:
            yield close()

    return run


def write_token_files(ids: DataFrame, folder: str, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Write what ``token_ids`` gives into files under ``folder`` in ascending doc_id
    order (null first); the manifest: part, path, n_docs, n_tokens, start.

    Rows with equal doc_ids stay together, in no set order.  An empty table
    writes no file.
    """
    spark = ids.sparkSession
    packed = materialize(ids, "ids")
    counted = (map_batches(packed.select("ids"), _counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
               .toPandas())  # one row per vocabulary entry at most
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted["id"]] = counted["n"]
    lengths = zlib.compress(code_lengths(counts).tobytes(), 9)
    n_files = max(1, math.ceil(int(counts.sum()) / ids_per_file))
    # one bound per file: the largest doc_id of each range
    bounds = [r.hi for r in packed.select("doc_id").repartitionByRange(n_files, "doc_id")
              .groupBy(F.spark_partition_id().alias("p")).agg(F.max("doc_id").alias("hi")).orderBy("p").collect()
              if r.hi is not None][:-1]
    coded = map_batches(packed, _coder(lengths, bounds),
                        "part int, doc_id long, n_tokens long, code binary, checkpoints binary")
    dealt = coded.repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "doc_id")
    files = map_batches(dealt, _file_writer(folder.rstrip("/"), lengths),
                        "part int, path string, n_docs long, n_tokens long")
    files = materialize(files, "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_file(path: str, ids_at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in the file, its ids) of each document, in order."""
    fs, inner = open_store(path)
    with fs.open_input_file(inner) as f:
        size = f.size()
        tail = f.read_at(32, size - 32)
        n_docs, a, b = struct.unpack("<QQQ", tail[:24])
        if tail[24:] != MAGIC:
            raise ValueError(f"{path} isn't a token file")
        head = struct.unpack("<Q", f.read_at(8, len(MAGIC)))[0]
        codec = Codec(np.frombuffer(zlib.decompress(f.read_at(head, len(MAGIC) + 8)), np.uint8))
        data0 = len(MAGIC) + 8 + head
        data1 = size - 32 - a - b
        docs = np.frombuffer(zlib.decompress(f.read_at(a, data1)), "<i8").reshape(n_docs, 5)
        marks = np.frombuffer(zlib.decompress(f.read_at(b, data1 + a)), "<u4").astype(np.int64)
        first_mark = np.cumsum(docs[:, 4]) - docs[:, 4]
        start = np.cumsum(docs[:, 2]) - docs[:, 2]
        chunk = start // ids_at_once
        for lo, hi in zip(*(lambda c: (c, np.append(c[1:], n_docs)))(np.flatnonzero(np.diff(chunk, prepend=-1)))):
            d = docs[lo:hi]
            at0 = int(d[0, 3])
            end = int(docs[hi, 3]) if hi < n_docs else data1 - data0
            m = marks[first_mark[lo]:first_mark[hi - 1] + d[-1, 4]] + np.repeat((d[:, 3] - at0) * 8, d[:, 4])
            nth = np.arange(len(m)) - np.repeat(first_mark[lo:hi] - first_mark[lo], d[:, 4])
            left = np.minimum(BLOCK, np.repeat(d[:, 2], d[:, 4]) - nth * BLOCK)
            ids = codec.decode(f.read_at(end - at0, data0 + at0), m, left)
            cuts = np.cumsum(d[:, 2])
            for i in range(len(d)):
                yield (int(d[i, 0]) if d[i, 1] else None, int(start[lo + i]),
                       ids[cuts[i] - d[i, 2]:cuts[i]])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: start
    counts the ids of all documents before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(k, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                        for k, at, ids in read_file(path)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return map_batches(manifest.select("path", "start").repartition(n), run,
                       "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame, tokenizer: str, ids_per_file: int = IDS_PER_FILE,
                          added_tokens: bool = False) -> DataFrame:
    """Encode every text, write the files under the shared folder, read them back."""
    folder = scratch_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(token_ids(docs, tokenizer, added_tokens=added_tokens), folder, ids_per_file))
