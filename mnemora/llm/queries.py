"""Queries and oracle SQL of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.audit import OP13_SQL, op13_filter_audit
from mnemora.llm.collocations import OP12_SQL, op12_collocations
from mnemora.llm.decontaminate import op2_decontamination
from mnemora.llm.line_dedup import op3_line_dedup
from mnemora.llm.lm import op7_lm_scoring
from mnemora.llm.media import op5_media
from mnemora.llm.near_dedup import op1_near_dedup
from mnemora.llm.packing import op8_packing
from mnemora.llm.quality import op4_quality
from mnemora.llm.repeats import OP11_SQL, op11_repetition
from mnemora.llm.secrets import op9_secrets
from mnemora.llm.shards import op6_shards
from mnemora.llm.warc import OP10_SQL, op10_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality": op4_quality,
    "op5_media": op5_media,
    "op6_shards": op6_shards,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_packing": op8_packing,
    "op9_secrets": op9_secrets,
    "op10_warc": op10_warc,
    "op11_repetition": op11_repetition,
    "op12_collocations": op12_collocations,
    "op13_filter_audit": op13_filter_audit,
}


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5_media that SQL can check."""
    checked = ("payload_bytes", "payload_sha256", "tail_crc32")
    return op5_media(spark, sf_dir, checked).select("doc_id", "n_bytes", *checked)


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_lm_scoring that SQL can check."""
    got = op7_lm_scoring(spark, sf_dir)
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_secrets that SQL can check."""
    return op9_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES |= {"media_payloads": media_payloads, "lm_base_scores": lm_base_scores, "secret_counts": secret_counts}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(regexp_split_to_array({_LOW}, '[\\x20\\x09-\\x0D]+'), lambda t: t <> '')"
#: crc(bytes): CRC-32 of a list of byte values, by a table made of its polynomial.
_CRC = "tbl AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
_crc = lambda octets: f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
_octets = lambda h, n: f"list_transform(range({n}), lambda i: ('0x' || substr({h}, (2 * i + 1)::BIGINT, 2))::BIGINT)"

OP1_SQL = f"""WITH RECURSIVE wrd AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM wrd),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
lnk AS (SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) + any_value(b.n) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2) WHERE 100 * c >= 80 * (n - c)),
edg AS (SELECT a, b FROM lnk UNION SELECT b, a FROM lnk),
walk(id, r) AS (SELECT a, b FROM edg UNION SELECT w.id, e.b FROM walk w JOIN edg e ON e.a = w.r),
low AS (SELECT id, min(r) AS r FROM walk GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(r, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(r, doc_id)) AS kept FROM sets LEFT JOIN low ON id = doc_id"""
MEDIA_SQL = f"""WITH {_CRC}, h AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, n_bytes, greatest(64, (n_bytes + 63) // 64 * 64) AS payload_bytes, h || repeat('00', greatest(64, (n_bytes + 63) // 64 * 64) - n_bytes) AS h FROM h)
SELECT doc_id, n_bytes, payload_bytes, sha256(unhex(h)) AS payload_sha256, {_crc(_octets("right(h, 128)", 64))} AS tail_crc32 FROM p, tbl"""
LM_SQL = f"""WITH {_CRC}, d AS (SELECT doc_id, {_crc(_octets("hex(encode(doc_id::VARCHAR))", "len(doc_id::VARCHAR)"))} % 7 = 2 AS held_out, list_append({_WORDS}, chr(10)) AS w FROM documents, tbl),
k AS (SELECT doc_id, held_out, unnest(w) AS x FROM d), c AS (SELECT x, count(*) AS c FROM k WHERE NOT held_out GROUP BY x), t AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 6) AS base_score FROM k LEFT JOIN c USING (x), t GROUP BY doc_id, held_out"""
_ANY = lambda word: "".join(f"[{ch.upper()}{ch}]" if ch.isalpha() else ch for ch in word)
_NAMES = "|".join([*(_ANY(w) for w in ("password", "passwd", "secret", "token")), _ANY("api") + "_?" + _ANY("key")])
SECRET_SQL = f"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?:{_NAMES})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda v: length(v) >= 6))::BIGINT AS n_assign,
len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20))::BIGINT AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda v: length(v) >= 24))::BIGINT AS n_hex FROM documents"""
ORACLE_SQL: dict[str, str] = {"op1_near_dedup": OP1_SQL, "op10_warc": OP10_SQL, "op11_repetition": OP11_SQL, "op12_collocations": OP12_SQL, "op13_filter_audit": OP13_SQL, "media_payloads": MEDIA_SQL, "lm_base_scores": LM_SQL, "secret_counts": SECRET_SQL}
