"""The queries of this subpackage, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docweave.llm.archives import archive_round_trip
from docweave.llm.bpe import encode_documents
from docweave.llm.chat_windows import chat_report
from docweave.llm.exact_dedup import exact_duplicates
from docweave.llm.fill_middle import fill_in_middle_report
from docweave.llm.near_dedup import near_duplicates
from docweave.llm.packing import pack_documents
from docweave.llm.quality import quality_report
from docweave.llm.secrets import scan_secrets
from docweave.llm.substring_dedup import remove_repeats
from docweave.llm.token_counts import count_tokens
from docweave.llm.toxicity import toxicity
from docweave.llm.vector_codes import vector_code_report


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), whole_runs=True)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_report(documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_code_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: A conversation whose texts look like a template's marks.
MARKED = " SELECT -1 AS conv_id, k AS turn, if(k = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2) AS t(k)"


def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(spark.sql(MARKED))
    return chat_report(turns, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


OP1_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM d),
n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 75 * (nx.n + ny.n - i)),
r AS (
  SELECT doc_id, doc_id AS root FROM d
  UNION
  SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id WHERE r.root < e.y)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, r.doc_id = min(root) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

#: Base32 of a SHA-1: each five hexadecimal digits are four letters.
OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(digest, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM p
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM d WHERE len(w) >= 50),
k AS (
  SELECT doc_id, p, sha256(array_to_string(w[p:p + 49], ' ')) AS block FROM b),
f AS (
  SELECT doc_id, p, min(doc_id) OVER (PARTITION BY block) AS first FROM k),
g AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM f WHERE first < doc_id),
h AS (
  SELECT doc_id, list(q) AS gone FROM g GROUP BY doc_id),
j AS (
  SELECT d.doc_id, w, coalesce(len(gone), 0) AS n,
         list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)) AS kept
  FROM d LEFT JOIN h ON h.doc_id = d.doc_id)
SELECT doc_id, len(w) AS n_words, n AS n_removed,
       sha256(array_to_string(list_transform(kept, lambda i: w[i]), ' ')) AS kept_sha256
FROM j
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h
  FROM documents),
r AS (
  SELECT *, list_transform(range(0, 4), lambda i: CAST('0x' || substr(h, CAST(1 + 8 * i AS BIGINT), 8) AS BIGINT)) AS k FROM d),
c AS (
  SELECT *, least(k[1] % (len(u) + 1), k[2] % (len(u) + 1)) AS a, greatest(k[1] % (len(u) + 1), k[2] % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k[3] % 100 >= 100 THEN 'plain'
              WHEN k[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM r),
p AS (
  SELECT doc_id, t, len(u) AS n, form, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

#: A round: all parts against all entries of their codebook, then the floors of the means.
_OP12_ROUND = """
a{k} AS MATERIALIZED (
  SELECT part, vec_id, any_value(label) AS label, any_value(x) AS x, min(struct_pack(d := list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))), e := e)) AS b
  FROM p JOIN c{k} USING (part) GROUP BY part, vec_id)"""
_OP12_MEANS = """,
m{k} AS (
  SELECT part, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c
  FROM (SELECT part, b.e AS e, i, CAST(sum(x[i]) AS DOUBLE) AS s, count(*) AS n FROM a{k}, range(1, 1 + (SELECT max(len(x)) FROM p)) t(i) GROUP BY part, b.e, i) GROUP BY part, e),
c{next} AS (
  SELECT part, e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (part, e)),"""

OP12_SQL = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT vec_id, label, part, q[1 + part * (len(q) // 16):(part + 1) * (len(q) // 16)] AS x FROM v, range(16) t(part)),
c0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
{_OP12_ROUND.format(k=0)}{_OP12_MEANS.format(k=0, next=1)}
{_OP12_ROUND.format(k=1)}{_OP12_MEANS.format(k=1, next=2)}
{_OP12_ROUND.format(k=2)},
o AS (
  SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', CAST(b.e AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM c2) AS codebooks_sha256
FROM o
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_secret_scan": op3_secret_scan,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_vector_codes": op12_vector_codes,
    "op13_chat_windows": op13_chat_windows,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op4_minhash_near_dedup": OP4_SQL,
    "op8_warc": OP8_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
}
