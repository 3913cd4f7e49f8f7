"""The opN queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import chat_digests, format_chats
from .importance import resample
from .lz_fingerprint import lz_fingerprints
from .merge_dropout import round_trips
from .packing import pack
from .pii import cue_forms, pii_spans
from .pseudo_likelihood import pseudo_likelihood
from .repetition import repetition
from .simhash_dedup import near_duplicates
from .substring_dedup import deduplicate

WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repetition(documents(spark, sf_dir), min_repeat=5, max_covered_percent=40, max_longest=60)
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "base_failed", "kept")


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS ws FROM d),
win AS (SELECT doc_id, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (5), (8), (61)) t(k))),
rep AS (SELECT doc_id, k, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT CASE WHEN k = 8 THEN p END) AS c8, count(DISTINCT CASE WHEN k = 5 THEN p END) AS c5, bool_or(k = 61) AS long
  FROM (SELECT doc_id, k, unnest(range(i, i + k)) AS p FROM rep) GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')))
   - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')))))::BIGINT AS n_dup_lines,
  coalesce(c8, 0)::BIGINT AS n_repeat_words, coalesce(c5, 0)::BIGINT AS covered_words, coalesce(long, false) AS long
  FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, base_failed,
  NOT base_failed AND NOT long AND 100 * covered_words <= 40 * n_words AS kept FROM f
"""


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    known = chats.schema
    extra = spark.range(2).select(
        F.lit(-7).cast(known["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(known["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chat_digests(format_chats(chats.union(extra)))


OP2_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
o AS (SELECT *, lag(role) OVER w AS p, lead(role) OVER w AS n FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g'))
    + CASE WHEN p IS NULL OR p <> role THEN 6 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) ELSE 8 END
    + CASE WHEN n IS NULL OR n <> role THEN 9 ELSE 0 END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return got.select("doc_id", "n_features", "log_weight", "gumbel_key", F.col("selected").alias("kept"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(documents(spark, sf_dir))


def _found(kind: str, rank: int, pattern: str, value: str, check: str) -> str:
    """SQL for the matches of a pattern in turn: the texts between them give their positions.

    value: the part of match m that is the span, at its end; check: what must hold for it, as v.
    """
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, e - length(v) AS s, e, v FROM (
  SELECT doc_id, {value} AS v, list_sum(list_transform(gaps[:i], lambda x: length(x))) + list_sum(list_transform(ms[:i], lambda x: length(x))) AS e
  FROM (SELECT doc_id, gaps, ms, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m
    FROM (SELECT doc_id, regexp_extract_all(text, '(?s)(.*?)({pattern})', 1) AS gaps, regexp_extract_all(text, '(?s)(.*?)({pattern})', 2) AS ms FROM d))) WHERE {check}"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr({_DIGITS}, -i, 1)::INT ELSE (substr({_DIGITS}, -i, 1)::INT * 2) // 10 + (substr({_DIGITS}, -i, 1)::INT * 2) % 10 END)) % 10 = 0"
_CUES = "|".join(cue_forms())
_SECRET = rf"\b(?:{_CUES})[\x22\x27]?[ \t]*[:=][ \t]*[\x22\x27]?[A-Za-z0-9_+/.=-]{{8,}}"
_VALUE = r"regexp_extract(m, '^[A-Za-z_]+[\x22\x27]?[ \t]*[:=][ \t]*[\x22\x27]?([A-Za-z0-9_+/.=-]{8,})$', 1)"
_MOD97 = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(regexp_replace(substr(v, 5) || substr(v, 1, 4), '(.)', '\\1,', 'g'), ',')[:length(v)], lambda c: (CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)::BIGINT)), lambda a, b: (a * (CASE WHEN b > 9 THEN 100 ELSE 10 END) + b) % 97) = 1"
OP3_SQL = "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS (" + " UNION ALL ".join(
    [
        _found("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "m", "true"),
        _found("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "m", "list_bool_and(list_transform(string_split(v, '.'), lambda p: coalesce(try_cast(p AS HUGEINT) <= 255, false)))"),
        _found("card", 2, r"[0-9](?:[\x20-]?[0-9])+", "m", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
        _found("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", "m", f"length({_DIGITS}) BETWEEN 10 AND 15"),
        _found("url", 4, r"[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20/@\x22\x27<>]+@[A-Za-z0-9.-]+", "m", "true"),
        _found("secret", 5, _SECRET, _VALUE, "regexp_matches(v, '[0-9]')"),
        _found("secret", 5, r"\bAKIA[0-9A-Z]{16}\b", "m", "true"),
        _found("account", 6, r"\bIBAN[ \t]*[:=]?[ \t]*[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", r"regexp_extract(m, '([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})$', 1)", _MOD97),
    ]
) + """),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card, count(*) FILTER (rank = 3) AS n_phone,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (rank < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), rate=0.1, seed=42)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprints(documents(spark, sf_dir))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=3, limit=3)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(documents(spark, sf_dir), rounds=2)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir), window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP9_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY g) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM rep),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


QUERIES = {"op1_suffix_array_repetition": op1, "op2_relational_chat": op2, "op3_anchor_pii": op3, "op4_importance_resampling": op4, "op5_merge_dropout": op5, "op6_lz_fingerprint": op6, "op7_gray_simhash": op7, "op8_masked_pseudo_likelihood": op8, "op9_sketch_substring_dedup": op9, "op10_bin_completion_packing": op10}
ORACLES = {"op1_suffix_array_repetition": OP1_SQL, "op2_relational_chat": OP2_SQL, "op3_anchor_pii": OP3_SQL, "op9_sketch_substring_dedup": OP9_SQL}
