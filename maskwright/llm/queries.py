"""One query per operator over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import bpe, compression, extract, jaccard, lexical, licenses, maxent, mixing, private, quality, repeats, topk, whitening


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract(table(spark, folder, "pages"))


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op3_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.repeated(table(spark, folder, "documents"))


def op4_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_private_data(spark: SparkSession, folder: str) -> DataFrame:
    return private.detect(table(spark, folder, "documents"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"))


def op7_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents"))


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"))


def op9_maxent_lm(spark: SparkSession, folder: str) -> DataFrame:
    return maxent.score(table(spark, folder, "documents"))


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return compression.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_mix_sources": op2_mix_sources,
    "op3_repeated_passages": op3_repeated_passages,
    "op4_exact_topk": op4_exact_topk,
    "op5_private_data": op5_private_data,
    "op6_quality_rules": op6_quality_rules,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_bpe": op8_bpe,
    "op9_maxent_lm": op9_maxent_lm,
    "op10_license_scan": op10_license_scan,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_lexical_search": op12_lexical_search,
    "op13_quality_classifier": op13_quality_classifier,
}

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM sized GROUP BY source
), leveled AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS level FROM sources
), summed AS (
  SELECT *, sum(cap) OVER w AS caps, sum(weight) OVER w AS weights,
         (SELECT sum(source_size) FROM sources)::DOUBLE AS total, (SELECT sum(weight) FROM sources) AS all_weight
  FROM leveled WINDOW w AS (ORDER BY level, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), capped AS (
  SELECT *, caps + level * (all_weight - weights) <= total AS at_cap FROM summed
), top AS (
  SELECT coalesce(max(caps), 0) AS caps, coalesce(max(weights), 0) AS weights FROM capped WHERE at_cap
), targets AS (
  SELECT source, source_size, CASE WHEN at_cap THEN cap
         ELSE least(cap, CASE WHEN all_weight > top.weights THEN (total - top.caps) / (all_weight - top.weights) ELSE 0 END * weight) END AS target
  FROM capped, top
), merits AS (
  SELECT s.source, length(bin(s.size)) AS merit, sum(s.size)::BIGINT AS words FROM sized s GROUP BY ALL
), claims AS (
  SELECT m.*, t.source_size, t.target, 3.0::DOUBLE * sum(words) OVER w AS filled, sum(merit * words) OVER w AS claimed,
         sum(merit * words) OVER (PARTITION BY m.source) AS all_claims
  FROM merits m JOIN targets t ON m.source IS NOT DISTINCT FROM t.source
  WINDOW w AS (PARTITION BY m.source ORDER BY merit DESC ROWS UNBOUNDED PRECEDING)
), filled AS (
  SELECT *, filled + 3.0::DOUBLE / merit * (all_claims - claimed)::DOUBLE <= target AS is_full FROM claims
), used AS (
  SELECT *, coalesce(max(CASE WHEN is_full THEN filled END) OVER s, 0) AS used, coalesce(max(CASE WHEN is_full THEN claimed END) OVER s, 0) AS met
  FROM filled WINDOW s AS (PARTITION BY source)
), due AS (
  SELECT source, merit, words, source_size, target, CASE WHEN words = 0 THEN 0 WHEN is_full THEN 3.0::DOUBLE
         ELSE least(3.0::DOUBLE, (target - used) / (all_claims - met)::DOUBLE * merit) END AS copies
  FROM used
), parts AS (
  SELECT *, floor(copies) AS whole, copies - floor(copies) AS part, sum(floor(copies) * words) OVER (PARTITION BY source) AS certain FROM due
), placed AS (
  SELECT s.doc_id, s.size, d.source, d.source_size, d.target, d.whole, d.part, d.certain,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN parts d ON s.source IS NOT DISTINCT FROM d.source AND length(bin(s.size)) = d.merit
), ranked AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY pareto, doc_id, size ROWS UNBOUNDED PRECEDING) AS sofar
  FROM (SELECT *, CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) ELSE 'inf'::DOUBLE END AS pareto FROM placed)
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (whole + CASE WHEN part > 0 AND sofar - size / 2 <= target - certain THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked
"""

QUALITY_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT row, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs
), windows AS (
  SELECT row, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM split)
), again AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, a, b, c) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS step(k) GROUP BY row
), lines AS (
  SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row
), measured AS (
  SELECT doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs JOIN split USING (row) LEFT JOIN lines USING (row) LEFT JOIN covered USING (row)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
), hosts AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS fails FROM failed GROUP BY source
), total AS (
  SELECT sum(n) AS docs, sum(fails) / sum(n) AS mean, count(*) AS hosts, sum(fails * fails / n) AS squares FROM hosts
), moments AS (
  SELECT mean, mean * (1 - mean) AS spread,
         (squares - docs * mean * mean - (hosts - 1) * mean * (1 - mean)) / docs AS between_hosts FROM total
), prior AS (
  SELECT mean, CASE WHEN between_hosts > 0 THEN greatest(2.0, spread / between_hosts - 1) ELSE 1e6 END AS strength FROM moments
), bad AS (
  SELECT source FROM hosts, prior WHERE (fails + strength * mean) / (n + strength) > 0.5
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM failed.source) AS kept
FROM failed
"""

TOPK_SQL = r"""
WITH plain AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM (SELECT DISTINCT ON (vec_id) * FROM plain WHERE vec_id % 50 = 0) q JOIN plain c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

REPEATS_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT row, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM split)
), again AS (
  SELECT h FROM windows GROUP BY h HAVING count(DISTINCT row) > 1
), hits AS (
  SELECT row, doc_id, i, coalesce(i > lag(i) OVER w + 50, true) AS new FROM windows SEMI JOIN again USING (h)
  WINDOW w AS (PARTITION BY row ORDER BY i)
), islands AS (
  SELECT *, sum(new::INT) OVER (PARTITION BY row ORDER BY i) AS island FROM hits
)
SELECT DISTINCT doc_id, first_word, end_word FROM (
  SELECT row, doc_id, (min(i) - 1)::INT AS first_word, (max(i) + 49)::INT AS end_word FROM islands GROUP BY row, doc_id, island
)
"""


SEARCH_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), corpus AS (
  SELECT count(*)::BIGINT AS N, sum(len(terms))::BIGINT AS L FROM docs WHERE len(terms) > 0
), counted AS (
  SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY row, term
), weighted AS (
  SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, corpus GROUP BY term, N
), asked AS (
  SELECT item, item_id, term, count(*)::BIGINT AS times FROM (
    SELECT row_number() OVER () AS item, item_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
  ) GROUP BY item, item_id, term
), sized AS (
  SELECT row, doc_id, 100 - 25 + ((25 * len(terms)::BIGINT * N) // L) AS m FROM docs, corpus WHERE len(terms) > 0
), scored AS (
  SELECT item, item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN weighted USING (term) JOIN counted USING (term) JOIN sized USING (row) GROUP BY item, item_id, row, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
) WHERE rank <= 20
"""


def license_sql() -> str:
    """Every window against every template of its length, without hashes."""
    rows = []
    for name, body in licenses.TEMPLATES:
        words = licenses.template_words(body)
        length = min(x for x in licenses.LENGTHS if len(words) <= x)
        own = ", ".join(f"'{x}'" for x in licenses.template_shingles(words))
        rows.append(f"('{name}', {length}, [{own}])")
    return rf"""
WITH templates(license, len, own) AS (VALUES {", ".join(rows)}),
split AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents
), windows AS (
  SELECT row, doc_id, len, s AS word, w[s + 1:s + len + len // 2] AS w
  FROM (SELECT *, unnest(range(0, len(w), len // 2)) AS s FROM split, (SELECT DISTINCT len FROM templates))
), shingled AS (
  SELECT row, doc_id, len, word, list_distinct([array_to_string(w[j:j + 4], ' ') FOR j IN range(1, len(w) - 3)]) AS g
  FROM windows WHERE len(w) >= 5
), held AS (
  SELECT row, doc_id, license, word, len(list_intersect(g, own)) / len(own) AS containment FROM shingled JOIN templates USING (len)
)
SELECT DISTINCT doc_id, license, containment, word::INT AS word FROM held WHERE containment >= 0.8
QUALIFY row_number() OVER (PARTITION BY row, license ORDER BY containment DESC, word) = 1
"""


ORACLES: dict[str, str] = {
    "op2_mix_sources": MIX_SQL, "op3_repeated_passages": REPEATS_SQL, "op4_exact_topk": TOPK_SQL, "op6_quality_rules": QUALITY_SQL,
    "op10_license_scan": license_sql(), "op12_lexical_search": SEARCH_SQL,
}
