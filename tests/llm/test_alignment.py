"""Alignment against a plain one of whole texts by both libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest

from podium.llm import alignment

SCHEMA = "doc_id long, text string, n_a string, radix int"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def plain(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    decoder = alignment.byte_decoder()

    def b_token(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    found = []
    for doc_id, text in docs:
        ids_a, ids_b, links, groups = [], [], [], []
        if text:
            data = (" " + text).encode()
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(decoder[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [b_token(i) for i in ids_b]
            if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
                ids_a, ids_b = [], []
            else:
                ends = [{}, {}]
                for side, parts in enumerate((bytes_a, bytes_b)):
                    at = 0
                    for n, x in enumerate(parts):
                        at += len(x)
                        ends[side][at] = n
                i = j = 0
                for at in sorted(set(ends[0]) & set(ends[1])):
                    x, y = ends[0][at], ends[1][at]
                    links.append((ids_a[x], ids_b[y]))
                    groups.append(",".join(map(str, ids_a[i:x + 1])) + "|" + ",".join(map(str, ids_b[j:y + 1])))
                    i, j = x + 1, y + 1
        found.append((doc_id, len(ids_a), len(ids_b), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if links else ""))
    count = Counter(link for *_, links, _ in found for link in links)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(((-1 if d is None else d), n_a, n_b, len(links), len(links), sum(count[k] == best[k[1]] for k in links),
                   sum(count[k] for k in links), sha) for d, n_a, n_b, links, sha in found)


def given():
    rng = random.Random(3)
    words = ["the", "Straße", "naïve", "don't", "a", "token", "<s>", "<|endoftext|>", "12345", "x=y;", "été", "uncommonlyword", "…", "日本", "🙂"]
    docs = [(i, rng.choice([" ", " ", "\n", "  "]).join(rng.choices(words[:rng.choice([11, 12, 15])], k=rng.randint(1, 40))))
            for i in range(150)]
    docs += [(200, None), (201, ""), (202, " "), (203, " lead"), (204, "trail \n"), (205, "a▁b"), (206, "tab\there\r\n\r\nx"),
             (207, "\x00nul"), (208, "é combining"), (209, "the"), (209, "the"), (None, "the end"), (210, "\nfirst\nlast\n"),
             (211, "ab " * 4000 + "z" * 3000)]
    return docs


@pytest.mark.parametrize("options", [{}, {"radix": 4, "chunk_bytes": 300, "fan_in": 3, "files_per_task": 2}])
def test_alignment_is_the_plain_one(spark, monkeypatch, options):
    monkeypatch.setattr(alignment, "PAIRS_PER_BLOCK", 16)
    docs = given()
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], SCHEMA).repartition(4)
    got = alignment.align(df, A, B, **options).collect()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == plain(docs)


def test_cut_words_are_as_whole_texts(spark):
    tool = alignment.Aligner(A, B)
    assert tool.by_word
    texts = [t for _, t in given() if t]
    for text, found in zip(texts, tool.align(texts)):
        whole = tool._whole(text)
        assert (found is None) == (whole is None)
        if found:
            assert found[:4] == whole[:4] and found[4].tolist() == whole[4].tolist()


def test_words_are_forgotten_beyond_a_bound(monkeypatch):
    monkeypatch.setattr(alignment, "WORDS", 20)
    tool, fresh = alignment.Aligner(A, B), alignment.Aligner(A, B)
    texts = [f"word{i} and the other{i % 3}" for i in range(60)]
    for i in range(0, 60, 7):
        for text, found in zip(texts[i:i + 7], tool.align(texts[i:i + 7])):
            assert found[3] == fresh._whole(text)[3]


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).isEmpty()
    lone = spark.createDataFrame([(1, None, "", 0)], SCHEMA)
    assert [tuple(r) for r in alignment.align(lone, A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
