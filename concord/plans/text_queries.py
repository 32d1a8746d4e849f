"""Queries of the text layer (T*), and S1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from ..operators import chunking
from .common import PAGES, WHOLE_PARAGRAPHS, duck, spread, sql, table

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return _STRIP.format(x)


KEY = rf"regexp_replace(regexp_replace(regexp_replace({strip('line')}, '\s+', ' ', 'g'), '\bPage\s+\d+\b', 'Page N', 'gi'), '\b\d{{1,3}}\s*/\s*\d{{1,3}}\b', 'N/N', 'g')"
LINES = f"""pages AS ({duck(PAGES)}), lines AS (SELECT doc, page_no, i, line, {KEY} AS key FROM (SELECT doc, page_no, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc, page_no, string_split(page_text, chr(10)) AS l FROM pages))),
full_lines AS (SELECT *, row_number() OVER (PARTITION BY doc, page_no ORDER BY i) AS top, row_number() OVER (PARTITION BY doc, page_no ORDER BY i DESC) AS bottom FROM lines WHERE regexp_matches(line, '\\S')),
running AS (SELECT doc, key, count(*) AS n FROM (SELECT DISTINCT doc, page_no, key FROM full_lines WHERE (top <= 3 OR bottom <= 3) AND length(key) BETWEEN 3 AND 120) JOIN (SELECT doc, count(*) AS n_pages FROM pages GROUP BY doc) USING (doc)
 GROUP BY doc, key, n_pages HAVING n_pages >= 3 AND count(*) >= greatest(3, floor(n_pages * 0.30)))"""


def t2_running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.running_lines(sql(spark, sf_dir, PAGES, "documents"))


def t3_strip_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.strip_pages(sql(spark, sf_dir, PAGES, "documents")).select("doc", "page_no", F.length("page_text").alias("n"), F.md5("page_text").alias("digest"))


def t4_t8_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sql(spark, sf_dir, WHOLE_PARAGRAPHS, "documents")
    return df.select("doc_id", tx.heading(F.col("text")).alias("heading"), tx.low_information(F.col("text")).alias("low_information"), tx.is_meta(F.col("text")).alias("meta"))


T48_SQL = f"""WITH d AS ({duck(WHOLE_PARAGRAPHS)}), s AS (SELECT doc_id, text, {strip("text")} AS s, trim(string_split({strip("text")}, chr(10))[1], ' ') AS f FROM d)
SELECT doc_id, CASE WHEN length(f) < 60 AND ((upper(f) = f AND lower(f) <> f) OR regexp_matches(f, '^\\d+[.\\d]*\\s+[0-9A-Za-z_]') OR suffix(f, ':')) THEN f END AS heading,
 length(s) < 200 OR len(regexp_extract_all(s, '[A-Z][^.!?]{{15,}}[.!?]')) < 2 OR len(regexp_extract_all(s, '(?im)(?:table of contents|^\\s*\\d+\\.\\s+[A-Z][^\\n]{{3,60}}\\s*\\.{{3,}}\\s*\\d+\\s*$)')) >= 3
 OR (length(regexp_replace(s, '[^\\p{{Lu}}]', '', 'g')) / greatest(1, length(s)) > 0.35 AND len(regexp_extract_all(s, '[.!?;:]')) < 5) AS low_information,
 regexp_matches(text, '(?i){"|".join(lx.META)}') AS meta FROM s"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(sql(spark, sf_dir, WHOLE_PARAGRAPHS, "documents"))


def t5_t7_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "ord", F.length("text").alias("n"), F.md5("text").alias("digest"))


_UNIFIED = r"regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')"
CHUNKS_SQL = f"""d AS ({duck(WHOLE_PARAGRAPHS)}),
parts AS (SELECT doc_id, unnest(range(len(p))) AS part, unnest(p) AS text FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({_UNIFIED}, '\\n(\\d+[.\\d]*\\s+[A-Z])', chr(1) || '\\1', 'g'), chr(1)), lambda x: {strip("x")}), lambda x: x <> '') AS p FROM d)),
folds AS (
 SELECT doc_id, part, text, length(text) > 1000 AS long, 80 AS least, chr(10) AS sep FROM parts
 UNION ALL SELECT doc_id, -1, {_UNIFIED}, true, 150, ' ' FROM d),
paras AS (SELECT doc_id, part, least, sep, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {strip("x")}), lambda x: x <> '') AS p FROM folds WHERE long),
fold AS (
 SELECT doc_id, part, least, sep, p, 0 AS i, '' AS buffer, CAST([] AS VARCHAR[]) AS out FROM paras
 UNION ALL
 SELECT doc_id, part, least, sep, p, i + 1, CASE WHEN length(buffer) + length(p[i + 1]) <= 1000 THEN {strip("buffer || sep || p[i + 1]")} ELSE p[i + 1] END,
  CASE WHEN length(buffer) + length(p[i + 1]) <= 1000 OR length(buffer) < least THEN out ELSE list_append(out, buffer) END
 FROM fold WHERE i < len(p)),
folded AS (SELECT doc_id, part, CASE WHEN length(buffer) >= least THEN list_append(out, buffer) ELSE out END AS out FROM fold WHERE i = len(p)),
headed AS (SELECT doc_id, flatten(list(c ORDER BY part)) AS c FROM (
  SELECT doc_id, part, CASE WHEN long THEN out WHEN length(text) >= 40 THEN [text] ELSE [] END AS c FROM folds LEFT JOIN folded USING (doc_id, part) WHERE part >= 0) GROUP BY doc_id),
chosen AS (SELECT f.doc_id, len(coalesce(h.c, [])) >= 3 AS by_heading, CASE WHEN len(coalesce(h.c, [])) >= 3 THEN h.c ELSE f.out END AS c FROM folded f LEFT JOIN headed h USING (doc_id) WHERE f.part = -1),
chunks AS (SELECT doc_id, k - 1 AS ord, CASE WHEN by_heading OR k = 1 THEN c[k] ELSE {strip("right(c[k - 1], 200)")} || ' … ' || c[k] END AS text FROM chosen, unnest(range(1, len(c) + 1)) AS r(k))"""


def t9_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.label(_chunks(spark, sf_dir)).select("doc_id", "id", "label", "display", "heading", F.length("text").alias("n"))


T9_SQL = f"""WITH RECURSIVE {CHUNKS_SQL}, s AS (SELECT doc_id, ord, text, {strip("text")} AS s, trim(string_split({strip("text")}, chr(10))[1], ' ') AS f FROM chunks),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord)::INTEGER AS id, CASE WHEN length(f) < 60 AND ((upper(f) = f AND lower(f) <> f) OR regexp_matches(f, '^\\d+[.\\d]*\\s+[0-9A-Za-z_]') OR suffix(f, ':')) THEN f END AS found FROM s
 WHERE NOT (length(s) < 200 OR len(regexp_extract_all(s, '[A-Z][^.!?]{{15,}}[.!?]')) < 2 OR len(regexp_extract_all(s, '(?im)(?:table of contents|^\\s*\\d+\\.\\s+[A-Z][^\\n]{{3,60}}\\s*\\.{{3,}}\\s*\\d+\\s*$)')) >= 3
 OR (length(regexp_replace(s, '[^\\p{{Lu}}]', '', 'g')) / greatest(1, length(s)) > 0.35 AND len(regexp_extract_all(s, '[.!?;:]')) < 5)))
SELECT doc_id, id, 'Section ' || id AS label, 'Section ' || id || CASE WHEN found IS NULL THEN '' ELSE ': ' || left(found, 40) END AS display, coalesce(found, 'Section ' || id) AS heading, length(text)::INTEGER AS n FROM kept"""

_JOIN_ONCE = r"regexp_replace({0}, '([^.!?:])[ ]*\n([a-z])', '\1 \2', 'g')"
_BARE = "regexp_replace(" + _JOIN_ONCE.format(_JOIN_ONCE.format("text")) + r", '(?m)^\d+[.\d]*\s+[A-Z][^\n]{3,60}$', '', 'g')"
_CLEAN = r"regexp_replace(replace(" + strip("x") + r", chr(10), ' '), '\s{2,}', ' ', 'g')"
STATEMENTS_SQL = rf"""SELECT doc_id, unnest(range(len(s)))::INTEGER AS stmt_idx, unnest(s) AS statement FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({_BARE}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_CLEAN}),
 lambda x: length(x) >= 20 AND NOT regexp_matches(x, '(?i){"|".join(lx.META)}')) AS s FROM documents)"""


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.statement_rows(spread(table(spark, sf_dir, "documents")), "doc_id")


def t10_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statements(spark, sf_dir)


def t12_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("idx", "sentence"))


T12_SQL = rf"""SELECT doc_id, unnest(range(len(s)))::INTEGER AS idx, unnest(s) AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({strip(r"regexp_replace(text, '\s*\n\s*', ' ', 'g')")}, '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {strip("x")}), lambda x: length(x) >= 20) AS s FROM documents)"""


def _listed(tokens, name: str):
    return F.concat_ws(" ", F.array_sort(F.array_distinct(tokens))).alias(name)


def t13_t18_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("statement")
    return _statements(spark, sf_dir).select(
        "doc_id", "stmt_idx", F.concat_ws(" ", tx.bm25_tokens(s)).alias("bm25"), _listed(tx.keywords(s), "keywords"), _listed(tx.concept_tokens(s), "concepts"), _listed(tx.content_tokens(s), "content"), F.concat_ws(" ", tx.polarity_tokens(s)).alias("polarity"), tx.pair_key(s).alias("pair_key")
    )


def sql_set(expression: str, stop: list[str]) -> str:
    return f"list_filter({expression}, lambda t: NOT list_contains([{lx.sql_list(stop)}], t))"


KEYWORDS_SQL = sql_set("regexp_extract_all(lower({0}), '[a-z]{{3,}}')", lx.KEYWORD_STOPWORDS)
CONCEPTS_SQL = sql_set(r"list_transform(regexp_extract_all({0}, '[A-Za-z]{{4,}}|\d+(?:[.,]\d+)*%?|\$[\d.,]+[BMK]?'), lambda t: regexp_replace(lower(t), 's+$', ''))", lx.CONCEPT_STOPWORDS)
T13_SQL = rf"""WITH s AS ({STATEMENTS_SQL}) SELECT doc_id, stmt_idx, array_to_string(list_filter(regexp_split_to_array(lower(statement), '\s+'), lambda t: length(t) > 1 AND NOT list_contains([{lx.sql_list(lx.BM25_STOPWORDS)}], t)), ' ') AS bm25,
 array_to_string(list_sort(list_distinct({KEYWORDS_SQL.format("statement")})), ' ') AS keywords, array_to_string(list_sort(list_distinct({CONCEPTS_SQL.format("statement")})), ' ') AS concepts,
 array_to_string(list_sort(list_distinct({sql_set("list_filter(list_transform(regexp_extract_all(lower(statement), '[a-z][a-z-]{3,}'), lambda t: regexp_replace(t, 's+$', '')), lambda t: length(t) >= 4)", lx.CONTENT_STOPWORDS)})), ' ') AS content,
 array_to_string(list_transform(regexp_extract_all(statement, '[A-Za-z'']+'), lambda t: lower(t)), ' ') AS polarity, regexp_replace(lower({strip("statement")}), '\s+', ' ', 'g') AS pair_key FROM s"""


def s1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 for HTML pages: text without scripts, styles, comments and tags."""
    from ..sources.pages import html_text

    return table(spark, sf_dir, "pages").select("page_id", F.length(html_text(F.col("html"))).alias("n"), F.md5(html_text(F.col("html"))).alias("digest"))


S1_SQL = rf"""SELECT page_id, length(t)::INTEGER AS n, md5(t) AS digest FROM (SELECT page_id, {strip(r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t]+', ' ', 'g')")} AS t FROM pages)"""

QUERIES = {
    "t2_running_lines": t2_running_lines, "t3_strip_pages": t3_strip_pages, "t4_t8_t11_headings_whole": t4_t8_headings, "t5_t7_chunks_whole": t5_t7_chunks, "t9_labels_whole": t9_labels,
    "t10_statements": t10_statements, "t12_sentences": t12_sentences, "t13_t18_tokens": t13_t18_tokens, "s1_page_text": s1_page_text,
}
ORACLE_SQL = {
    "t2_running_lines": f"WITH {LINES} SELECT doc, key, n FROM running",
    "t3_strip_pages": rf"""WITH {LINES} SELECT doc, page_no, length(t)::INTEGER AS n, md5(t) AS digest FROM (SELECT p.doc, p.page_no, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS t FROM pages p
 LEFT JOIN (SELECT l.* FROM lines l LEFT JOIN running r USING (doc, key) WHERE r.key IS NULL AND NOT regexp_matches(line, '{tx.NOISE_LINE}')) l USING (doc, page_no) GROUP BY ALL)""",
    "t4_t8_t11_headings_whole": T48_SQL,
    "t5_t7_chunks_whole": f"WITH RECURSIVE {CHUNKS_SQL} SELECT doc_id, ord::INTEGER AS ord, length(text)::INTEGER AS n, md5(text) AS digest FROM chunks",
    "t9_labels_whole": T9_SQL, "t10_statements": STATEMENTS_SQL, "t12_sentences": T12_SQL, "t13_t18_tokens": T13_SQL, "s1_page_text": S1_SQL,
}
