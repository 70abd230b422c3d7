"""Queries over the text operators, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from millrace.llm import (
    bpe,
    decontaminate,
    html_text,
    lexical_search,
    line_dedup,
    ngram_join,
    packing,
    pii,
    quality_model,
    quality_rules,
    toxicity,
    vector_codes,
    warc,
)
from millrace.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_repeats(docs)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.entities(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenized(table(spark, sf_dir, "documents"), bpe.public_vocabulary)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"), bpe.public_vocabulary)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_decontaminate": op4_decontaminate,
    "op5_warc": op5_warc,
    "op6_html_text": op6_html_text,
    "op7_quality_rules": op7_quality_rules,
    "op8_bpe": op8_bpe,
    "op9_ngram_join": op9_ngram_join,
    "op10_quality_model": op10_quality_model,
    "op11_vector_codes": op11_vector_codes,
    "op12_packing": op12_packing,
    "op13_lexical_search": op13_lexical_search,
    "pipeline": pipeline,
}

#: A-Z in lower case, other letters as they are.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4 = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(p) WHERE len(w) > 0),
places AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM w, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) AS t(p)),
hits AS (SELECT DISTINCT doc_id, item_id, p, n FROM places JOIN windows USING (n, s)),
words AS (
  SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM hits, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS bigint) AS n_words, CAST(coalesce(n_hit, 0) AS bigint) AS n_hit,
       CAST(coalesce(n_items, 0) AS bigint) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_BITS = "0000000100100011010001010110011110001001101010111100110111101111"
_OP5 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p),
bits AS (
  SELECT page_id, array_to_string(list_transform(string_split(hex, ''),
    lambda c: substr('{_BITS}', 4 * (instr('0123456789abcdef', c) - 1) + 1, 4)), '') AS bits FROM h),
digests AS (
  SELECT page_id, array_to_string(list_transform(range(0, 32),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
      + 16 * CAST(bits[5 * i + 1] AS int) + 8 * CAST(bits[5 * i + 2] AS int) + 4 * CAST(bits[5 * i + 3] AS int)
      + 2 * CAST(bits[5 * i + 4] AS int) + CAST(bits[5 * i + 5] AS int), 1)), '') AS payload_digest FROM bits),
firsts AS (SELECT hex, min(page_id) AS first FROM h GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact
FROM h JOIN firsts USING (hex) JOIN digests USING (page_id)
"""

_SLACK = " ".join(f"WHEN '{k}' THEN {v}" for k, v in quality_rules.SLACK.items())
_RATES = ", ".join(f"{{'rate': '{k}', 'v': {k}}}" for k in quality_rules.SLACK)
_OUTSIDE = " OR ".join(f"(k.rate = '{k}' AND f.{k} NOT BETWEEN k.lo AND k.hi)" for k in quality_rules.SLACK)
_GROUP = "PARTITION BY level, lang, source, rate"
_OP7 = rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS s FROM w, unnest(range(1, len(w) - 3)) AS t(p)),
again AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
r AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM again, unnest(range(0, 5)) AS u(k) GROUP BY doc_id),
c AS (
  SELECT doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         1000 * n_symbols // greatest(n_words, 1) AS symbol_rate, 100 * word_chars // greatest(n_words, 1) AS word_length,
         1000 * n_dup_lines // greatest(n_lines, 1) AS line_rate FROM c),
s AS (
  SELECT lang, source, u.rate AS rate, cast(u.v AS BIGINT) AS v
  FROM (SELECT lang, source, unnest([{_RATES}]) AS u FROM f WHERE NOT base_failed)),
b AS (
  SELECT lang, source, rate, e * 32 + (v >> e) AS bucket, count(*) AS n
  FROM (SELECT *, cast(greatest(0, length(bin(v)) - 6) AS BIGINT) AS e FROM s) GROUP BY ALL),
m AS (
  SELECT 2 * grouping(lang) + grouping(source) AS level, lang, source, rate, bucket, sum(n) AS n FROM b
  GROUP BY GROUPING SETS ((lang, source, rate, bucket), (lang, rate, bucket), (rate, bucket))),
u AS (
  SELECT *, sum(n) OVER ({_GROUP} ORDER BY bucket) AS upto, sum(n) OVER ({_GROUP}) AS total,
         CASE WHEN bucket < 64 THEN bucket ELSE (bucket - (bucket // 32 - 1) * 32) << (bucket // 32 - 1) END AS v FROM m),
q AS (
  SELECT level, lang, source, rate, max(total) AS total, min(v) FILTER (upto * 4 >= total) AS q1,
         min(v) FILTER (upto * 4 >= total * 3) AS q3 FROM u GROUP BY level, lang, source, rate),
x AS (
  SELECT *, q1 - {quality_rules.REACH} * (q3 - q1) - (CASE rate {_SLACK} END) AS lo,
         q3 + {quality_rules.REACH} * (q3 - q1) + (CASE rate {_SLACK} END) AS hi FROM q),
k AS (
  SELECT o.lang, o.source, o.rate,
         CASE WHEN o.total >= {quality_rules.MIN_DOCS} THEN o.lo WHEN l.total >= {quality_rules.MIN_DOCS} THEN l.lo ELSE a.lo END AS lo,
         CASE WHEN o.total >= {quality_rules.MIN_DOCS} THEN o.hi WHEN l.total >= {quality_rules.MIN_DOCS} THEN l.hi ELSE a.hi END AS hi
  FROM x o JOIN x l ON l.level = 1 AND l.rate = o.rate AND l.lang IS NOT DISTINCT FROM o.lang
  JOIN x a ON a.level = 3 AND a.rate = o.rate WHERE o.level = 0)
SELECT doc_id, cast(n_words AS BIGINT) AS n_words, cast(word_chars AS BIGINT) AS word_chars,
       cast(n_symbols AS BIGINT) AS n_symbols, cast(n_dup_lines AS BIGINT) AS n_dup_lines,
       cast(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (
         SELECT 1 FROM k WHERE k.lang IS NOT DISTINCT FROM f.lang AND k.source IS NOT DISTINCT FROM f.source
           AND ({_OUTSIDE})) AS kept
FROM f
"""


#: Links by all pairs of shared shingles, then all that they lead to.
_OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS s
  FROM w, unnest(range(1, greatest(len(w) - 1, 2))) AS t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS c FROM edges UNION SELECT reach.doc_id, e.b FROM reach JOIN edges e ON reach.c = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(doc_id, c), doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) USING (doc_id)
"""


def _op11() -> str:
    """Codes by comparing every part with every entry, round by round."""
    steps = [
        """
v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS u FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
parts AS (
  SELECT vec_id, label, u, p, u[p * (len(u) // 16) + 1:(p + 1) * (len(u) // 16)] AS c FROM v, unnest(range(0, 16)) AS t(p)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
b0 AS (SELECT p, e, c FROM parts JOIN firsts USING (vec_id))"""
    ]
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(f"""
n{k} AS (
  SELECT vec_id, label, a.p AS p, a.c AS c, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(a.c, b.c),
    lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), e := e)) AS best
  FROM parts a JOIN b{k} b ON a.p = b.p GROUP BY ALL)""")
        if k < vector_codes.ROUNDS:
            steps.append(f"""
m{k} AS (
  SELECT p, e, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS c FROM (
    SELECT p, best.e AS e, i, sum(c[i]) AS s, count(*) AS n FROM n{k}, unnest(range(1, len(c) + 1)) AS t(i) GROUP BY ALL)
  GROUP BY p, e),
b{k + 1} AS (SELECT p, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e))""")
    last = vector_codes.ROUNDS
    return "WITH" + ",".join(steps) + f""",
codes AS (
  SELECT vec_id, label, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM n{last} GROUP BY vec_id, label),
totals AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM codes GROUP BY label)
SELECT vec_id, code, error, label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{last}) AS codebooks_sha256
FROM codes JOIN totals ON codes.label IS NOT DISTINCT FROM totals.label
"""


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OP13 = rf"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, a GROUP BY term, docs),
s AS (
  SELECT item_id, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM i JOIN tf USING (term) JOIN w USING (term) JOIN lengths USING (doc_id), a GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""

ORACLES: dict[str, str] = {
    "op9_ngram_join": _OP9,
    "op11_vector_codes": _op11(),
    "op13_lexical_search": _OP13,
    "op4_decontaminate": _OP4,
    "op5_warc": _OP5,
    "op7_quality_rules": _OP7,
}
