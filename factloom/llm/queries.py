"""One query for each operator over its whole table, with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_preferences, decontaminate, exact_topk, language_id, lexical_search, licenses, line_dedup, near_dup, ngram_lm, substring_dedup, toxicity
from .bpe import encode_decode

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    return encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, full=False)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are left after windows of 13 words repeated from smaller ids are removed."""
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"), window=13, full=False)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with a stale last answer."""
    return chat_preferences.stale_preferences(_table(spark, sf_dir, "conversations"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.predict(docs, language_id.fit(docs), {"doc_id": "long"})
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")), full=False)
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_sentences", "worst_sentence")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"), full=False)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of two lines or more, and of single lines of more than 50 words."""
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents"), min_lines=2, lone_words=50)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", "shared_run", F.sha2("text", 256).alias("kept_sha256"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that stand in a window of 10 words of a benchmark item."""
    out = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other vectors for every 50th vector."""
    return exact_topk.exact_topk(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents by a trigram model of nine tenths of them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (~language_id.held_out(F.col("doc_id"), 10)).alias("learn"))
    return ngram_lm.fit_and_score(docs, "learn", keep=False)[1]


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for each benchmark item."""
    return lexical_search.lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {
    "op1_near_dup": op1_near_dup,
    "op2_bpe": op2_bpe,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_licenses": op7_licenses,
    "op8_line_dedup": op8_line_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_exact_topk": op10_exact_topk,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_lexical_search": op12_lexical_search,
}

_OP3 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
windows AS (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM words)),
removed AS (
  SELECT DISTINCT doc_id, p + k AS p
  FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS least FROM windows), (SELECT unnest(range(0, 13)) AS k)
  WHERE least < doc_id),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM removed GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
              ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)), lambda i: w[i]), ' '), '') END) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
"""

_OP4 = """
WITH rows AS (SELECT DISTINCT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
last AS (SELECT pair_id, max(turn) FILTER (role = 'assistant') AS last FROM rows GROUP BY pair_id),
rejected AS (SELECT DISTINCT pair_id, turn, role, CASE WHEN turn = last AND role = 'assistant' THEN 'I can''t help with that.' ELSE text END AS text
             FROM rows JOIN last USING (pair_id) WHERE last IS NULL OR turn <= last),
both_sides AS (SELECT pair_id, turn, role, text, bool_or(c) AS in_chosen, bool_or(NOT c) AS in_rejected
               FROM (SELECT *, true AS c FROM rows UNION ALL SELECT *, false FROM rejected) GROUP BY ALL),
parting AS (SELECT pair_id, min(turn) FILTER (NOT (in_chosen AND in_rejected)) AS parting, max(turn) FILTER (in_chosen) AS c, max(turn) FILTER (in_rejected) AS r FROM both_sides GROUP BY pair_id),
placed AS (SELECT both_sides.*, parting IS NULL OR turn < parting AS common, coalesce(c >= parting AND r >= parting, false) AS paired FROM both_sides JOIN parting USING (pair_id)),
sides AS (
  SELECT *, 'prompt' AS side FROM placed WHERE common
  UNION ALL SELECT *, 'chosen' FROM placed WHERE NOT common AND in_chosen
  UNION ALL SELECT *, 'rejected' FROM placed WHERE NOT common AND in_rejected),
named AS (SELECT *, '<|im_start|>' || coalesce(role, 'unknown') || chr(10) AS header, replace(coalesce(text, ''), '<|', '< |') AS body, NOT common AND coalesce(role, '') = 'assistant' AS train FROM sides)
SELECT pair_id, side, turn, coalesce(role, 'unknown') AS role, header || body || '<|im_end|>' || chr(10) AS content, train,
       CASE WHEN train THEN CAST(length(header) AS INT) END AS train_from, CASE WHEN train THEN CAST(length(header) + length(body) AS INT) END AS train_to, paired
FROM named
"""

_OP8 = r"""
WITH rows AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL),
powers AS (SELECT CAST(pow(2, unnest(range(0, 1 + CAST(ceil(log2(greatest(max(len(l)), 1))) AS INT)))) AS INT) AS k FROM rows),
ids AS (SELECT doc_id, list_transform(l, lambda x: CAST(hash(x) AS VARCHAR)) AS h, list_transform(l, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) > 50) AS lone FROM rows),
suffixes AS (SELECT doc_id, k, p, lone[p] AS lone, array_to_string(h[p:p + k - 1], ' ') AS prefix
             FROM (SELECT doc_id, h, lone, k, unnest(range(1, len(h) - k + 2)) AS p FROM ids, powers WHERE k <= len(h))),
ranked AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY k, prefix) AS n, first_value(doc_id) OVER w AS of_doc, first_value(p) OVER w AS of_p
           FROM suffixes WINDOW w AS (PARTITION BY k, prefix ORDER BY doc_id, p)),
lines AS (SELECT doc_id, p + unnest([0, 1]) AS p FROM ranked WHERE k = 2 AND r > 1 UNION SELECT doc_id, p FROM ranked WHERE k = 1 AND r > 1 AND lone),
gone AS (SELECT doc_id, list(p) AS ps FROM lines GROUP BY doc_id),
deepest AS (SELECT doc_id, p, max(k) AS k, arg_max(of_doc, k) AS of_doc, arg_max(of_p, k) AS of_p FROM ranked WHERE k >= 2 AND r > 1 GROUP BY doc_id, p),
heads AS (SELECT *, CASE WHEN lag(p) OVER w = p - 1 AND lag(of_doc) OVER w = of_doc AND lag(of_p) OVER w = of_p - 1 THEN 0 ELSE 1 END AS head FROM deepest WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
islands AS (SELECT doc_id, min(p) AS start, max(p + k) AS stop FROM (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM heads) GROUP BY doc_id, run),
runs AS (SELECT doc_id, count(*) AS n_runs, max(stop - start) AS longest_run
         FROM (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM islands) WHERE reach IS NULL OR stop > reach GROUP BY doc_id),
depth AS (SELECT doc_id, max(k) AS shared_run FROM ranked WHERE n > 1 GROUP BY doc_id)
SELECT doc_id, coalesce(len(l), 0) AS n_lines, coalesce(len(ps), 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, CAST(coalesce(longest_run, 0) AS BIGINT) AS longest_run, coalesce(shared_run, 0) AS shared_run,
       sha256(CASE WHEN ps IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(ps, i)), lambda i: l[i]), chr(10)), '') END) AS kept_sha256
FROM rows LEFT JOIN gone USING (doc_id) LEFT JOIN depth USING (doc_id) LEFT JOIN runs USING (doc_id)
"""

_OP9 = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM items WHERE len(w) > 0)),
grams AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, (SELECT DISTINCT CAST(n AS INT) AS n FROM wins) WHERE n <= len(w))),
found AS (SELECT r, p, n, item_id FROM grams JOIN wins USING (n, g)),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS place FROM found) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS names FROM found GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

_OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

#: Probabilities are rounded to the operator's grid, in the same doubles.
_OP11 = r"""
WITH RECURSIVE crc_table AS (
  SELECT n, list_reduce(list_prepend(n, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(0, 256)) AS n)),
crc AS (SELECT (SELECT list(v ORDER BY n) FROM crc_table) AS t),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w,
         coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10 = 0, false) AS held_out
  FROM documents, crc),
places AS (SELECT r, held_out, unnest(range(1, len(w) + 2)) AS p, w FROM docs),
tokens AS (
  SELECT r, held_out, p, CASE WHEN p <= len(w) THEN w[p] ELSE ' end' END AS c, CASE WHEN p > 1 THEN w[p - 1] ELSE ' start' END AS b, CASE WHEN p > 2 THEN w[p - 2] WHEN p = 2 THEN ' start' END AS a FROM places),
one AS (SELECT c, count(*) AS n FROM tokens WHERE NOT held_out GROUP BY c),
two AS (SELECT b, c, count(*) AS n FROM tokens WHERE NOT held_out GROUP BY b, c),
three AS (SELECT a, b, c, count(*) AS n FROM tokens WHERE NOT held_out AND a IS NOT NULL GROUP BY a, b, c),
total AS (SELECT coalesce(sum(n), 0) AS total, count(*) AS v FROM one),
starts AS (SELECT count(*) AS n FROM docs WHERE NOT held_out),
counted AS (
  SELECT tokens.*, total, v, coalesce(one.n, 0) AS n1, CASE WHEN tokens.b = ' start' THEN starts.n ELSE coalesce(x.n, 0) END AS nb, coalesce(two.n, 0) AS nbc, coalesce(y.n, 0) AS nab, CASE WHEN tokens.a = ' start' THEN starts.n ELSE coalesce(z.n, 0) END AS na, coalesce(three.n, 0) AS nabc
  FROM tokens, total, starts LEFT JOIN one ON one.c = tokens.c LEFT JOIN one x ON x.c = tokens.b LEFT JOIN one z ON z.c = tokens.a LEFT JOIN two ON two.b = tokens.b AND two.c = tokens.c
       LEFT JOIN two y ON y.b = tokens.a AND y.c = tokens.b LEFT JOIN three ON three.a = tokens.a AND three.b = tokens.b AND three.c = tokens.c),
stored AS (
  SELECT *, CASE WHEN nbc > 0 THEN pow(10, -least(round_even(-log10(nbc / (nb + PRIOR2)) * 4096, 0), 65534) / 4096) ELSE 0 END AS s2,
         CASE WHEN nab > 0 THEN pow(10, -least(round_even(-log10(nab / (na + PRIOR2)) * 4096, 0), 65534) / 4096) * (na + PRIOR2) ELSE 0 END AS pair,
         CASE WHEN nabc > 0 THEN pow(10, -least(round_even(-log10(nabc / (nab + PRIOR3)) * 4096, 0), 65534) / 4096) ELSE 0 END AS s3
  FROM counted),
likely AS (SELECT *, s2 + PRIOR2 / (nb + PRIOR2) * ((n1 + 1) / (total + v + 1)) AS p2 FROM stored)
SELECT doc_id, docs.held_out, n_tokens, n_known, CAST(train_tokens AS BIGINT) AS train_tokens, base_score, score
FROM docs JOIN (SELECT r, count(*) AS n_tokens, count(*) FILTER (n1 > 0) AS n_known, max(total) AS train_tokens, sum(log10((n1 + 0.1) / (total + 0.1 * (v + 1)))) AS base_score,
                       sum(log10(CASE WHEN a IS NULL THEN p2 ELSE s3 + PRIOR3 / (pair + PRIOR3) * p2 END)) AS score FROM likely GROUP BY r) USING (r)
""".replace("PRIOR2", repr(ngram_lm.PRIOR_2)).replace("PRIOR3", repr(ngram_lm.PRIOR_3))

_OP12 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL),
held AS (SELECT r, doc_id, len(w) AS n, w FROM docs WHERE len(w) > 0),
sums AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM held),
postings AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM held) GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), sums),
scored AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) AS BIGINT) AS score
           FROM asked JOIN postings USING (term) JOIN weights USING (term), sums GROUP BY item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLE_SQL = {"op3_substring_dedup": _OP3, "op4_chat_format": _OP4, "op8_line_dedup": _OP8, "op9_decontaminate": _OP9, "op10_exact_topk": _OP10, "op11_lm_scoring": _OP11, "op12_lexical_search": _OP12}
