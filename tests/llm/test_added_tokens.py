import json
import struct
import zlib

import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from podium.llm import queries, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b c\nd", "x <|endoftext|", "<|endoftext|><|endoftext|> y",
         "plain words only", "É 中 <|endoftext|>  two", ""]


def test_added_tokens_equal_an_unmodified_library():
    library = Tokenizer.from_file(PATH)
    e = token_files.Encoder(PATH, added_tokens=True)
    assert e.by_word
    got = [x.tolist() for x in e.encode(pa.array(TEXTS))]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert got[0] == [64, 220, 50256, 275]


def test_contents_with_white_space_and_plain_added_tokens(tmp_path):
    spec = json.loads(Tokenizer.from_file(PATH).to_str())
    plain = {**spec["added_tokens"][0], "id": 50257, "content": "dwo", "special": False}
    for content in ("dwo", "b c"):
        path = str(tmp_path / f"{len(content.split())}.json")
        with open(path, "w") as f:
            json.dump({**spec, "added_tokens": [*spec["added_tokens"], {**plain, "content": content}]}, f)
        library = Tokenizer.from_file(path)
        texts = [*TEXTS, "the dwords b", "c a b", "a b c", "b", "c"]
        got = token_files.Encoder(path, added_tokens=True).encode(pa.array(texts))
        assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_counts_added_tokens(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library, start, want = Tokenizer.from_file(PATH), 0, []
    for i, t in enumerate(TEXTS):
        ids = library.encode(t, add_special_tokens=False).ids + [token_files.END_ID]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op6_token_files(spark, str(tmp_path)).collect()) == want
