"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import encode_decode
from .common import documents
from .linededup import line_digests
from .media import text_media
from .packing import pack_documents
from .rules import STOP_WORDS, quality_rules
from .simhash import near_duplicates
from .tokenfile import token_files
from .toxicity import score_toxicity
from .weaklabel import classify
from .wrapper import main_text


def queries() -> dict:
    return {
        "op1_matroska": lambda spark, d: text_media(documents(spark, d)),
        "op2_quality_classifier": lambda spark, d: classify(documents(spark, d)),
        "op3_packing": lambda spark, d: pack_documents(documents(spark, d)),
        "op4_line_dedup": lambda spark, d: line_digests(documents(spark, d)),
        "op5_quality_rules": lambda spark, d: quality_rules(documents(spark, d)),
        "op6_simhash": lambda spark, d: near_duplicates(documents(spark, d)),
        "op7_bpe": lambda spark, d: encode_decode(documents(spark, d)),
        "op8_toxicity": lambda spark, d: score_toxicity(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
        "op9_token_files": lambda spark, d: token_files(documents(spark, d)),
        "op10_html_extraction": lambda spark, d: main_text(spark.read.parquet(f"{d}/pages.parquet")),
    }


_STOPS = ", ".join(f"'{w}'" for w in sorted(set().union(*STOP_WORDS.values())))

OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, i, lines[i] AS line, translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT rid, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
f AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
k AS (SELECT rid, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS kept FROM l WHERE key NOT IN (SELECT key FROM f) GROUP BY rid)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""

OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest(range(0, 8)) AS o) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
             len(list_filter(w, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stops,
             length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper,
             (length(text) - length(replace(text, '!', '')))::BIGINT AS n_bangs,
             len(list_filter(l, lambda x: length(x) - length(replace(x, '|', '')) >= 3))::BIGINT AS n_bar_lines
      FROM d LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 14.0 * n_words
       AND NOT n_symbols::DOUBLE > 0.06::DOUBLE * word_chars::DOUBLE AND NOT n_bangs::DOUBLE > 0.25::DOUBLE * n_words::DOUBLE
       AND NOT n_upper::DOUBLE > 0.5::DOUBLE * word_chars::DOUBLE AND NOT (n_stops::DOUBLE < 0.02::DOUBLE * n_words::DOUBLE AND n_words >= 50)
       AND NOT n_dup_lines::DOUBLE > 0.5::DOUBLE * n_lines::DOUBLE AND NOT n_bar_lines::DOUBLE > 0.34::DOUBLE * n_lines::DOUBLE AS kept,
       n_lines, n_stops, n_upper, n_bangs, n_bar_lines
FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op5_quality_rules": OP5_SQL}
