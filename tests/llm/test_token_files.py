import heapq
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from podium.llm import huffman, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = list("abcdeé ßÀ12²½.,'!\"-\n\n    \t'") + ["'s", "'ll", " the", "<|endoftext|>", "\xa0", "\x85", "\x1c", "\xad", "中", "🙂", " "]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def _texts(n, seed):
    rng = random.Random(seed)
    plain = [c for c in ALPHABET if c not in "\t\xa0\x85\x1c中🙂 "]
    return ["".join(rng.choice(plain if rng.random() < 0.7 else ALPHABET) for _ in range(rng.randrange(60)))
            if rng.random() < 0.7 else " ".join("".join(rng.choices("abé.,'2", k=rng.randrange(1, 6))) for _ in range(30))
            .replace(" b", "\nb") for _ in range(n)]


@pytest.mark.parametrize("words", [token_files.WORDS, 3000])
def test_encoder_equals_the_library(library, monkeypatch, words):
    monkeypatch.setattr(token_files, "WORDS", words)
    e = token_files.Encoder(PATH)
    assert e.by_word
    texts = _texts(3000, 1) + ["", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a\n b", "a \nb", "a\n\nb", "\na"]
    cut = 0
    for i in range(0, len(texts), 100):
        part = texts[i:i + 100]
        cut += sum(not re.search(token_files.ODD.replace("x{a1}", "xa1").replace("x{ff}", "xff"), t) for t in part)
        for t, ids in zip(part, e.encode(pa.array(part))):
            assert ids.tolist() == library(t), repr(t)
    assert cut > 500


def _plain_huffman_cost(counts):
    heap = [c for c in counts if c]
    if len(heap) == 1:
        return heap[0]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    return cost


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 300):
        counts = rng.integers(0, 1000, n)
        counts[0] = 1
        lengths = huffman.code_lengths(counts)
        assert int((lengths * counts).sum()) == _plain_huffman_cost(counts.tolist())
        assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
        assert ((lengths > 0) == (counts > 0)).all()
    steep = 2 ** np.arange(30, dtype=np.int64)
    for limit in (5, 8, 20):
        lengths = huffman.code_lengths(steep, limit)
        assert lengths.max() <= limit and lengths.min() > 0
        assert sum(2.0 ** -int(x) for x in lengths) <= 1
    # the best of all codes of at most 3 bits over 5 symbols
    import itertools
    counts = np.array([50, 20, 10, 3, 1])
    best = min(sum(a * b for a, b in zip(x, counts)) for x in itertools.product((1, 2, 3), repeat=5)
               if sum(2.0 ** -k for k in x) <= 1)
    assert int((huffman.code_lengths(counts, 3) * counts).sum()) == best
    assert not huffman.code_lengths(np.zeros(4, np.int64)).any()


def test_codes_round_trip_from_their_checkpoints():
    rng = np.random.default_rng(2)
    counts = np.maximum(1, (1e6 / np.arange(1, 50001) ** 1.5).astype(np.int64))
    codec = huffman.Codec(huffman.code_lengths(counts))
    assert codec.longest == codec.lengths.max() <= 17
    docs = [rng.choice(50000, n, p=counts / counts.sum()).astype(np.uint32) for n in (0, 1, 511, 512, 513, 5000)]
    coded = codec.encode_many(docs)
    assert all(a == c and (m == k).all() for (a, m), (c, k) in zip(coded, map(codec.encode, docs)))
    data, offsets, sizes, at = b"".join(c for c, _ in coded), [], [], 0
    for d, (c, marks) in zip(docs, coded):
        assert len(marks) == -(-len(d) // huffman.BLOCK)
        offsets += [8 * at + int(m) for m in marks]
        sizes += [min(huffman.BLOCK, len(d) - i) for i in range(0, len(d), huffman.BLOCK)]
        at += len(c)
    got = codec.decode(data, np.array(offsets), np.array(sizes))
    assert (got == np.concatenate(docs)).all()
    # a block alone, from its own offset
    alone = codec.decode(data, np.array(offsets[-1:]), np.array(sizes[-1:]))
    assert (alone == docs[-1][-sizes[-1]:]).all()
    with pytest.raises(ValueError):
        huffman.Codec(np.array([1, 1, 0], np.uint8)).encode(np.array([2]))


def test_files_round_trip(spark, library):
    texts = _texts(300, 3)
    rows = [(i * 3, t, "s", "n") for i, t in enumerate(texts)] + [(-5, None, "", ""), (10**12, "", "", ""), (0, texts[0], "", "")]
    rows.append((1, "long " * 30_000, "", ""))
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, n_tokens string").repartition(5)
    got = sorted((tuple(r) for r in token_files.token_file_round_trip(df, PATH, ids_per_file=2_000).collect()),
                 key=lambda r: r[1])
    start, want = 0, []
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = library(t or "") + [0]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == want


def test_files_of_null_keys_and_of_nothing(spark):
    schema = "doc_id long, text string"
    got = token_files.token_file_round_trip(spark.createDataFrame([(None, "a b"), (4, "c"), (None, None)], schema), PATH)
    rows = sorted(got.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 4] and rows[2].start == sum(r.n_tokens for r in rows[:2])
    assert token_files.token_file_round_trip(spark.createDataFrame([], schema), PATH).collect() == []
