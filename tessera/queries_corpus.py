"""Registered queries on loading, enriching, reporting and chunking, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import context_of, context_prefix, query_text, section_prefix
from tessera.chunk_sql import BLANK, JUDGMENT_CHUNKS, ONE_JUDGMENT, STATUTE_CHUNKS, STATUTE_CLAUSES, judgment_ctes, statute_ctes
from tessera.operators import report
from tessera.operators.chunking import clauses, judgment_chunks, merge_short, sentences_of, statute_chunks
from tessera.operators.enrich import STATUTE_NUMBERS, STATUTE_STRINGS, filled, unified_judgments, unified_statutes, whole_number, with_ontology
from tessera.session import spread
from tessera.sources.tables import latest_per_key, read_table


def statutes(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "phapdien_unified")


def judgments(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "anle_unified")


def topic_report(spark, folder):
    return report.top_groups(statutes(spark, folder), "topic_id", "content_word_count").select("topic_id", "n", F.col("mean").alias("mean_words"))


def subject_count(spark, folder):
    return statutes(spark, folder).agg(F.count_distinct("subject_id").alias("n_subjects"))


def statute_word_summary(spark, folder):
    return report.number_summary(statutes(spark, folder), "content_word_count")


def judgment_length_summary(spark, folder):
    return report.number_summary(judgments(spark, folder), "content_char_len")


def missing_statute_values(spark, folder):
    df = statutes(spark, folder)
    return report.missing_values(df, df.columns)


def missing_judgment_values(spark, folder):
    df = judgments(spark, folder)
    return report.missing_values(df, ["principle_text", "applied_article_code", "case_type", "content_markdown", "title"])


def judgment_value_counts(spark, folder):
    return report.value_counts(judgments(spark, folder), ["case_type", "court_level", "doc_type"])


def judgment_years(spark, folder):
    return report.positive_range(judgments(spark, folder), "year")


def chunk_types(spark, folder):
    return read_table(spark, folder, "chunk").groupBy("chunk_type").agg(F.count("*").alias("n"))


def chunk_sizes(spark, folder):
    return report.size_statistics(read_table(spark, folder, "chunk"), "chunk_char_len", "chunk_type")


def chunks_per_document(spark, folder):
    return report.per_parent(read_table(spark, folder, "chunk"), "doc_id", "chunk_id", "chunk_word_count")


def enriched_statutes(spark, folder):
    """Articles joined to topic and subject dimensions taken from the corpus itself, the last scrape counting."""
    rows = statutes(spark, folder)
    topics = rows.select("topic_id", "topic_title_vi", "topic_title_en", "topic_note", F.concat_ws("/", "scraped_at", "doc_id").alias("ord"))
    subjects = rows.select("subject_id", "subject_title_vi", "subject_title_en", F.concat_ws("/", "scraped_at", "doc_id").alias("ord"))
    return with_ontology(rows, topics, subjects)


def unify_statutes(spark, folder):
    return unified_statutes(enriched_statutes(spark, folder))


def unify_judgments(spark, folder):
    """Judgments under their raw names, with the text hash and the parser in columns of their own."""
    raw = judgments(spark, folder).withColumnsRenamed({"doc_id": "doc_name", "content_markdown": "markdown", "content_char_len": "char_len"})
    apart = {name: F.get_json_object("metadata_json", f"$.{name}") for name in ("text_hash", "parser_model")}
    return unified_judgments(raw.withColumns(apart).drop("metadata_json"))


def document_lengths(spark, folder):
    """Stale lengths as text, read back as whole numbers."""
    rows = read_table(spark, folder, "documents").select("doc_id", F.concat(F.col("n_chars").cast("string"), F.lit(".7")).alias("as_text"), "lang")
    return filled(rows.select("doc_id", whole_number("as_text").alias("n_chars"), "lang"))


def statute_prefixes(spark, folder):
    parts = [F.col(c) for c in ("topic_title_vi", "subject_title_vi", "chapter_title", "article_title")]
    return statutes(spark, folder).select("doc_id", context_prefix(*parts).alias("prefix")).distinct()


def judgment_prefixes(spark, folder):
    prefix = section_prefix(F.col("case_type"), F.col("title"), F.col("subject"), F.lit("findings"))
    return judgments(spark, folder).select("doc_id", prefix.alias("prefix")).distinct()


def chunk_contexts(spark, folder):
    chunks = read_table(spark, folder, "chunk")
    return chunks.select("chunk_id", context_of(F.col("embed_text"), F.col("chunk_text")).alias("context"), query_text(F.col("chunk_text")).alias("query")).distinct()


def latest_scrape(spark, folder):
    rows = statutes(spark, folder).withColumn("ord", F.struct("scraped_at", "article_id"))
    return latest_per_key(rows, "doc_id", "ord").select("doc_id", "scraped_at")


def statute_clauses(spark, folder):
    """How many clauses an article has before and after short ones are merged."""
    rows = statutes(spark, folder).select("doc_id", clauses(F.col("content_text")).alias("c"))
    return rows.select("doc_id", F.size("c").alias("n_clauses"), F.size(merge_short(F.col("c"))).alias("n_merged"))


def statute_clause_counts(spark, folder):
    """Clauses of every article as they are cut."""
    return statutes(spark, folder).select("doc_id", F.size(clauses(F.col("content_text"))).alias("n_clauses"))


def statute_chunk_rows(spark, folder):
    return statute_chunks(spread(statutes(spark, folder)))


def judgment_chunk_rows(spark, folder):
    rows = spread(judgments(spark, folder)).where("doc_id IS NOT NULL").distinct()
    return judgment_chunks(rows, sentences_of(rows))


def judgment_sentences(spark, folder):
    """The sentences of every judgment, as they are taken out of its text."""
    return sentences_of(spread(judgments(spark, folder))).drop("paragraph_kind")


def built_chunk_sizes(spark, folder):
    """Chunk types and sizes of the chunks that are made here."""
    both = statute_chunk_rows(spark, folder).select("chunk_type", "chunk_char_len").unionByName(judgment_chunk_rows(spark, folder).select("chunk_type", "chunk_char_len"))
    return report.size_statistics(both, "chunk_char_len", "chunk_type")


def hierarchy_counts(spark, folder):
    """Articles, with all their subjects and topics, counted at each level of the hierarchy."""
    rows = statutes(spark, folder).select("topic_id", "subject_id", "doc_id").distinct()
    return rows.rollup("topic_id", "subject_id").agg(F.countDistinct("doc_id").alias("n_articles"), F.grouping_id().cast("int").alias("level"))


QUERIES = {
    "statute_chunks": statute_chunk_rows,
    "judgment_chunks": judgment_chunk_rows,
    "judgment_sentences": judgment_sentences,
    "built_chunk_sizes": built_chunk_sizes,
    "statute_clauses": statute_clauses,
    "statute_clause_counts": statute_clause_counts,
    "topic_report": topic_report,
    "subject_count": subject_count,
    "statute_word_summary": statute_word_summary,
    "judgment_length_summary": judgment_length_summary,
    "missing_statute_values": missing_statute_values,
    "missing_judgment_values": missing_judgment_values,
    "judgment_value_counts": judgment_value_counts,
    "judgment_years": judgment_years,
    "chunk_types": chunk_types,
    "chunk_sizes": chunk_sizes,
    "chunks_per_document": chunks_per_document,
    "unify_statutes": unify_statutes,
    "unify_judgments": unify_judgments,
    "document_lengths": document_lengths,
    "statute_prefixes": statute_prefixes,
    "judgment_prefixes": judgment_prefixes,
    "chunk_contexts": chunk_contexts,
    "latest_scrape": latest_scrape,
    "hierarchy_counts": hierarchy_counts,
}

_STATUTE_COLUMNS = (
    "doc_id article_id article_title chapter_title topic_id topic_number topic_title_vi topic_title_en topic_note subject_id subject_number subject_title_vi "
    "subject_title_en content_text content_char_len content_word_count source_note_text related_note_text source_links_json source_url hierarchy_path scraped_at metadata_json"
).split()


def _missing_sql(table: str, columns: list[str]) -> str:
    parts = [f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE coalesce(CAST({c} AS VARCHAR), '') = '') AS n_missing, count(*) AS n FROM {table}" for c in columns]
    return f"SELECT column_name, n_missing, n_missing / n AS share FROM ({' UNION ALL '.join(parts)}) WHERE n_missing > 0"


def _strip(column: str) -> str:
    return f"regexp_replace(coalesce({column}, ''), '^\\s+|\\s+$', '', 'g')"


def _summary_sql(table: str, value: str) -> str:
    return f"SELECT CAST(sum({value}) AS BIGINT) AS total, avg({value}) AS mean, min({value}) AS least, max({value}) AS most, median({value}) AS median FROM {table}"


_PARTS = "list_filter([" + ", ".join(_strip(c) for c in ("topic_title_vi", "subject_title_vi", "chapter_title", "article_title")) + "], lambda x: x <> '')"
_ORD = "concat_ws('/', scraped_at, doc_id)"
_META = "to_json({" + ", ".join(f"'{c}': {c}" for c in ("article_id", "topic_id", "topic_number", "subject_id", "subject_number", "source_url")) + "})::VARCHAR"
_UNIFIED_SQL = f"""WITH t AS (
    SELECT topic_id AS t_id, arg_max({{'vi': topic_title_vi, 'en': topic_title_en, 'note': topic_note}}, {_ORD}) AS t FROM phapdien_unified WHERE topic_id <> '' GROUP BY 1
  ), s AS (SELECT subject_id AS s_id, arg_max({{'vi': subject_title_vi, 'en': subject_title_en}}, {_ORD}) AS s FROM phapdien_unified WHERE subject_id <> '' GROUP BY 1),
  u AS (
    SELECT p.* EXCLUDE (topic_title_vi, topic_title_en, topic_note, subject_title_vi, subject_title_en, hierarchy_path, metadata_json),
      coalesce(nullif(t.vi, ''), nullif(topic_title_vi, ''), '') AS topic_title_vi, coalesce(t.en, '') AS topic_title_en, coalesce(t.note, '') AS topic_note,
      coalesce(nullif(s.vi, ''), nullif(subject_title_vi, ''), '') AS subject_title_vi, coalesce(s.en, '') AS subject_title_en, {_META} AS metadata_json
    FROM phapdien_unified p LEFT JOIN t ON topic_id = t_id LEFT JOIN s ON subject_id = s_id
  )
  SELECT {", ".join(f"coalesce({c}, '') AS {c}" for c in STATUTE_STRINGS if c != "hierarchy_path")}, {", ".join(f"coalesce({c}, 0) AS {c}" for c in STATUTE_NUMBERS)},
    {"array_to_string(" + _PARTS + ", ' > ')"} AS hierarchy_path FROM u"""
_JUDGMENT_STRINGS = (
    "doc_id doc_code precedent_number title subject case_type doc_type doc_subtype issue_date adopted_date issuing_authority court_level jurisdiction applied_article_code "
    "principle_text content_markdown detail_url pdf_url source structure_json extracted_json parsed_at"
).split()
_JUDGMENT_NUMBERS = "year applied_article_number applied_article_clause content_char_len num_pages num_sections num_paragraphs num_sentences confidence".split()

SQL = {
    "statute_clause_counts": f"""SELECT doc_id, CASE WHEN coalesce(content_text, '') = '' THEN 0
        ELSE greatest(1, CAST(len(regexp_extract_all(content_text, '(?m)^[1-9]\\p{{Nd}}?\\.{BLANK}+[^\\n]{{15}}')) AS INTEGER)) END AS n_clauses FROM phapdien_unified""",
    "topic_report": "SELECT topic_id, count(*) AS n, avg(content_word_count) AS mean_words FROM phapdien_unified GROUP BY 1 ORDER BY n DESC, topic_id NULLS FIRST LIMIT 10",
    "subject_count": "SELECT count(DISTINCT subject_id) AS n_subjects FROM phapdien_unified",
    "statute_word_summary": _summary_sql("phapdien_unified", "content_word_count"),
    "judgment_length_summary": _summary_sql("anle_unified", "content_char_len"),
    "missing_statute_values": _missing_sql("phapdien_unified", _STATUTE_COLUMNS),
    "missing_judgment_values": _missing_sql("anle_unified", ["principle_text", "applied_article_code", "case_type", "content_markdown", "title"]),
    "judgment_value_counts": " UNION ALL ".join(
        f"(SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM anle_unified GROUP BY 2 ORDER BY n DESC, value NULLS FIRST LIMIT 10)" for c in ("case_type", "court_level", "doc_type")
    ),
    "judgment_years": 'SELECT min(year) AS first, max(year) AS "last" FROM anle_unified WHERE year > 0',
    "chunk_types": "SELECT chunk_type, count(*) AS n FROM chunk GROUP BY 1",
    "chunk_sizes": """SELECT chunk_type, count(*) AS n, avg(chunk_char_len) AS mean, min(chunk_char_len) AS least, max(chunk_char_len) AS most,
        list_sort(list(chunk_char_len))[count(*) // 2 + 1] AS upper_median FROM chunk WHERE chunk_char_len IS NOT NULL GROUP BY 1""",
    "chunks_per_document": """SELECT count(*) AS parents, CAST(sum(n) AS BIGINT) AS children, avg(n) AS mean, any_value(w.mean_words) AS mean_words, any_value(w.median_words) AS median_words
        FROM (SELECT doc_id, count(DISTINCT chunk_id) AS n FROM chunk GROUP BY 1), (SELECT avg(w) AS mean_words, median(w) AS median_words FROM (SELECT max(chunk_word_count) AS w FROM chunk GROUP BY chunk_id)) w""",
    "statute_chunks": STATUTE_CHUNKS,
    "statute_clauses": STATUTE_CLAUSES,
    "judgment_chunks": JUDGMENT_CHUNKS,
    "judgment_sentences": f"WITH RECURSIVE {judgment_ctes('anle_unified')} SELECT * FROM jd_sentences",
    "built_chunk_sizes": f"""WITH RECURSIVE {statute_ctes('phapdien_unified')}, {ONE_JUDGMENT}, {judgment_ctes('one_judgment')},
        both_chunks AS (SELECT chunk_type, chunk_char_len FROM made_statutes UNION ALL SELECT chunk_type, chunk_char_len FROM made_judgments)
        SELECT chunk_type, count(*) AS n, avg(chunk_char_len) AS mean, min(chunk_char_len) AS least, max(chunk_char_len) AS most,
        list_sort(list(chunk_char_len))[count(*) // 2 + 1] AS upper_median FROM both_chunks GROUP BY 1""",
    "unify_statutes": _UNIFIED_SQL,
    "unify_judgments": f"""SELECT {", ".join(f"coalesce({c}, '') AS {c}" for c in _JUDGMENT_STRINGS)}, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _JUDGMENT_NUMBERS)},
        to_json({{'text_hash': h ->> '$.text_hash', 'parser_model': h ->> '$.parser_model'}})::VARCHAR AS metadata_json
        FROM (SELECT *, CASE WHEN json_valid(metadata_json) THEN metadata_json::JSON END AS h FROM anle_unified)""",
    "document_lengths": "SELECT doc_id, coalesce(n_chars, 0) AS n_chars, coalesce(lang, '') AS lang FROM documents",
    "statute_prefixes": f"""WITH p AS (SELECT doc_id, {_PARTS} AS parts FROM phapdien_unified)
        SELECT DISTINCT doc_id, CASE WHEN len(parts) = 0 THEN '' ELSE array_to_string(list_filter(parts, lambda x, i: i = 1 OR x <> parts[i - 1]), ' > ') || chr(10) END AS prefix FROM p""",
    "judgment_prefixes": f"""SELECT DISTINCT doc_id, array_to_string(list_filter([
          CASE WHEN {_strip('case_type')} <> '' THEN '[' || {_strip('case_type')} || ']' ELSE '' END, {_strip('title')},
          CASE WHEN {_strip('subject')} <> '' THEN '(' || {_strip('subject')} || ')' ELSE '' END, '| Phần: Nhận định của Toà án'], lambda x: x <> ''), ' ') || chr(10) AS prefix
        FROM anle_unified""",
    "chunk_contexts": """SELECT DISTINCT chunk_id, CASE WHEN coalesce(chunk_text, '') <> '' AND ends_with(coalesce(embed_text, ''), chunk_text)
          THEN left(embed_text, length(embed_text) - length(chunk_text)) ELSE coalesce(embed_text, '') END AS context,
        'Instruct: Given a Vietnamese legal question, retrieve relevant legal passages that answer the question' || chr(10) || 'Query: ' || chunk_text AS query FROM chunk""",
    "latest_scrape": "SELECT doc_id, max(scraped_at) AS scraped_at FROM phapdien_unified WHERE doc_id IS NOT NULL GROUP BY 1",
    "hierarchy_counts": """SELECT topic_id, subject_id, count(DISTINCT doc_id) AS n_articles, CAST(grouping(topic_id, subject_id) AS INTEGER) AS level
        FROM phapdien_unified GROUP BY ROLLUP (topic_id, subject_id)""",
}
