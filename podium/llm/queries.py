"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, conversations, decontaminate, licenses, line_dedup, packing, quality, secrets, sharding, simhash,
               substring_dedup, token_files, warc)
from .common import table

N_SHARDS = 24


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    body = F.coalesce(F.col("text"), F.lit(""))
    out = sharding.contiguous_shards(
        docs, N_SHARDS, F.octet_length(body).cast("long") + 8, "doc_id",
        {"text_crc32": F.crc32(F.encode(body, "UTF-8"))})
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return records.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast("long").alias("refers_to"))


#: base32 of a hexadecimal digest: four characters for each five digits
OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(d.h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1)), '')
           AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f ON d.h = f.h
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), packing.word_length())


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_file_round_trip(table(spark, sf_dir, "documents"),
                                             public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", "text")


OP5_SQL = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
total AS (SELECT source, count(text) AS total FROM documents WHERE text IS NOT NULL GROUP BY source),
lines AS (SELECT source, unnest(list_distinct(ls)) AS line FROM d WHERE text IS NOT NULL),
freq AS (SELECT source, line, count(*) AS pages FROM lines
         WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY source, line),
boiler AS (SELECT f.source, list(f.line) AS bad FROM freq f JOIN total t ON f.source IS NOT DISTINCT FROM t.source
           WHERE pages >= {line_dedup.MIN_PAGES} AND pages * 100 > total * {line_dedup.RATIO_PERCENT}
           GROUP BY f.source),
kept AS (SELECT d.*, CASE WHEN b.bad IS NULL THEN ls
                          ELSE list_filter(ls, lambda x: NOT list_contains(b.bad, x)) END AS ks
         FROM d LEFT JOIN boiler b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(ls) - len(ks), 0) AS BIGINT) AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(ks, chr(10)), '') END AS text
FROM kept
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents labelled as good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_verdicts(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))
    return out.select("row.doc_id", *quality.BASE, "llr_micro", "kept")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    d = docs.select("doc_id")
    return d.join(found.withColumnRenamed("doc_id", "leak"), d["doc_id"].eqNullSafe(F.col("leak")), "left").select(
        "doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id", "matched")


_MASKS_SQL = ", ".join(f"({i}, {len(m)}, [{', '.join(str(j) for j, c in enumerate(m) if c == '1')}])"
                       for i, m in enumerate(decontaminate.MASKS))
_TOKENS_SQL = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_WINDOW_SQL = f"least({decontaminate.OVERLAP}, len(b.w))"
OP9_SQL = f"""
WITH m(mask, span, offs, whole) AS (  -- the last three are for items of so many tokens, which must agree in all
  SELECT *, CAST(NULL AS INTEGER) FROM (VALUES {_MASKS_SQL})
  UNION ALL VALUES ('1', 1, [0], 1), ('11', 2, [0, 1], 2), ('111', 3, [0, 1, 2], 3)),
d AS (SELECT doc_id, {_TOKENS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_TOKENS_SQL} AS w FROM benchmark),
dp AS (SELECT doc_id, w, mask, offs, unnest(range(len(w) - span + 1)) AS q FROM d, m
       WHERE whole IS NULL OR whole IN (SELECT len(w) FROM b)),
ds AS (SELECT doc_id, mask, q, hash(list_transform(offs, lambda o: w[q + o + 1])) AS k FROM dp),
bp AS (SELECT item_id, w, mask, offs, unnest(range(len(w) - span + 1)) AS p FROM b, m
       WHERE whole IS NULL OR whole = len(w)),
bs AS (SELECT item_id, mask, p, hash(list_transform(offs, lambda o: w[p + o + 1])) AS k FROM bp),
hits AS (SELECT doc_id, item_id, mask, q, p FROM ds JOIN bs USING (mask, k)),
windows AS (SELECT hits.doc_id, hits.item_id, d.w AS dw, b.w AS bw, q - p AS shift, {_WINDOW_SQL} AS width,
                   unnest(range(greatest(0, p + span - {_WINDOW_SQL}), least(p, len(b.w) - {_WINDOW_SQL}) + 1)) AS s
            FROM hits JOIN m USING (mask) JOIN d USING (doc_id) JOIN b USING (item_id)),
scored AS (SELECT doc_id, item_id, width, len(list_filter(range(width), lambda j:
                  shift + s + j >= 0 AND coalesce(dw[shift + s + j + 1] = bw[s + j + 1], false))) AS matched FROM windows),
leak AS (SELECT doc_id, min(item_id) AS item_id, CAST(max(matched) AS BIGINT) AS matched FROM scored
         WHERE matched * 100 >= width * {decontaminate.SIMILARITY} GROUP BY doc_id)
SELECT documents.doc_id, leak.item_id IS NOT NULL AS contaminated, leak.item_id, leak.matched
FROM documents LEFT JOIN leak ON documents.doc_id = leak.doc_id
"""


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.drop_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.trie(table(spark, sf_dir, "conversations"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secrets.BASE],
                        F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_warc": op2_warc,
    "op3_packing": op3_packing,
    "op4_licenses": op4_licenses,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_files": op6_token_files,
    "op7_simhash": op7_simhash,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_secrets": op12_secrets,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op5_line_dedup": OP5_SQL,
    "op9_decontamination": OP9_SQL,
}
