"""The pipelines from raw tables to a graph, one function per stage: each reads tables, and returns or writes tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.chunking import JUDGMENT_META, STATUTE_META, judgment_chunks, statute_chunks
from tessera.operators.enrich import filled, links_json, unified_judgments, unified_statutes, whole_number, with_ontology
from tessera.operators.extract import RESULT, Model, extract_with_model, failures, flat_results, overlaid, to_extract
from tessera.operators.graph import build_graph
from tessera.operators.report import missing_values, number_summary, positive_range, size_statistics, top_groups, value_counts
from tessera.session import cut_lineage
from tessera.sources.tables import load_tables, read_or_empty, save_tables, write_table

STATUTE_TABLES = ("articles", "subjects", "tree_nodes", "ontology_topics", "ontology_subjects", "ontology_glossary")
JUDGMENT_TABLES = ("documents", "sentences")
SENTENCE_NUMBERS = ("year", "page", "index_in_paragraph", "global_index", "char_start", "char_end")

NUMBERS = ("year", "applied_article_number", "applied_article_clause")
_TEXT = T.StringType()
MODEL_TABLES = {
    "extracted_entity": T.StructType([T.StructField(c, _TEXT) for c in ("mention_id", "chunk_id", "name", "type")]),
    "extracted_relation": T.StructType([T.StructField("relation_id", T.LongType()), *[T.StructField(c, _TEXT) for c in ("chunk_id", "source", "target", "type")]]),
}
CORPUS_TABLES = {
    "phapdien_unified": T.StructType([T.StructField(c, _TEXT) for c in (*STATUTE_META, "content_text", "source_links_json")]),
    "anle_unified": T.StructType([T.StructField(c, T.LongType() if c in NUMBERS else _TEXT) for c in (*JUDGMENT_META, "principle_text")]),
    "sentences": T.StructType(
        [T.StructField(c, T.LongType() if c.endswith("index") or c.startswith("index") else _TEXT) for c in ("doc_name", "paragraph_id", "section_kind", "paragraph_kind", "index_in_paragraph", "global_index", "text")]
    ),
}
RESULTS = T.StructType([T.StructField("chunk_id", _TEXT), T.StructField("part", T.IntegerType()), T.StructField("result", T._parse_datatype_string(RESULT))])


@dataclass(frozen=True)
class Job:
    """Where a pipeline reads and writes, and in which formats."""

    source: str
    target: str
    formats: tuple[str, ...] = ("parquet",)


def load_statutes(spark: SparkSession, job: Job) -> DataFrame:
    """Articles, enriched by their ontology and flattened, saved with the auxiliary tables (SRC1, JON1-3, PRJ1, JSN1, SNK2).

    The links of an article come as an array or as JSON already. Of repeated keys of the ontology the last by its column ``ord`` counts; a
    table without that column is ordered by all its columns.
    """
    tables = load_tables(spark, job.source, STATUTE_TABLES)
    articles = tables["articles"].withColumnsRenamed({"record_id": "doc_id"})
    if "source_links" in articles.columns:
        articles = articles.withColumn("source_links_json", links_json(F.col("source_links")))
    ordered = [t if "ord" in t.columns else t.withColumn("ord", F.struct(*t.columns)) for t in (tables["ontology_topics"], tables["ontology_subjects"])]
    unified = unified_statutes(with_ontology(articles, *ordered))
    write_table(unified, job.target, "phapdien_unified", job.formats)
    save_tables({name: tables[name] for name in STATUTE_TABLES[1:]}, job.target, job.formats)
    return unified


def load_judgments(spark: SparkSession, job: Job) -> tuple[DataFrame, DataFrame]:
    """Judgments and their cleaned sentences, saved (SRC2, PRJ2, PRJ4, SNK3)."""
    tables = load_tables(spark, job.source, JUDGMENT_TABLES)
    unified = unified_judgments(tables["documents"])
    sentences = filled(tables["sentences"].withColumns({c: whole_number(c) for c in SENTENCE_NUMBERS if c in tables["sentences"].columns}))
    write_table(unified, job.target, "anle_unified", job.formats)
    write_table(sentences, job.target, "sentences", job.formats)
    return unified, sentences


def report_statutes(unified: DataFrame) -> dict[str, DataFrame]:
    """Topics, words and missing values of the statutes (AGG1-4)."""
    return {
        "topics": top_groups(unified, "topic_title_vi", "content_word_count"),
        "words": number_summary(unified, "content_word_count"),
        "missing": missing_values(unified, unified.columns),
    }


def report_judgments(unified: DataFrame) -> dict[str, DataFrame]:
    """Frequent values, years, lengths and missing values of the judgments (AGG5-8)."""
    return {
        "values": value_counts(unified, ["case_type", "court_level", "doc_type"]),
        "years": positive_range(unified, "year"),
        "lengths": number_summary(unified, "content_char_len"),
        "missing": missing_values(unified, ["principle_text", "applied_article_code"]),
    }


def chunk(spark: SparkSession, job: Job) -> tuple[DataFrame, DataFrame]:
    """Chunks of both corpora, saved (SNK4, SNK5). A corpus that is missing has no chunks (SRC7). They are written once and read back, for
    several stages need them."""
    statutes, judgments, sentences = (read_or_empty(spark, f"{job.source}/{name}.parquet", schema) for name, schema in CORPUS_TABLES.items())
    of_statutes, of_judgments = cut_lineage(statute_chunks(statutes)), cut_lineage(judgment_chunks(judgments, sentences))
    write_table(of_statutes, job.target, "statute_chunks", job.formats)
    write_table(of_judgments, job.target, "judgment_chunks", job.formats)
    return of_statutes, of_judgments


def extract(spark: SparkSession, job: Job, chunks: list[DataFrame], model: Model, sample_size: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a model finds in the chunks that have no result yet, laid over the results that are there, saved (UDF4, UDF8, JON5, JON6).

    Returns (entities, relations, failures). Failed rows are counted and asked again by the next run (AGG17, UDF9)."""
    earlier = read_or_empty(spark, f"{job.source}/results.parquet", RESULTS)
    columns = ["chunk_id", "chunk_text", "embed_text"]
    both = reduce(DataFrame.unionByName, [c.select(*columns) for c in chunks]).dropDuplicates(["chunk_id"])
    asked = cut_lineage(extract_with_model(to_extract(both, earlier, sample_size=sample_size), model))
    failed = asked.where("error IS NOT NULL").select("chunk_id").distinct()
    results = overlaid(earlier, asked.join(failed, "chunk_id", "left_anti"))
    entities, relations = flat_results(results)
    write_table(results, job.target, "results", ("parquet",))
    return entities, relations, failures(asked)


def chunk_and_link(spark: SparkSession, job: Job, model: Model | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks of both corpora and the graph of them, saved; returns nodes and edges (SNK4-6). What a model finds comes from ``model``, or,
    without one, from ``extracted_entity`` and ``extracted_relation`` (UDF7); inputs that are missing make their stage do nothing (SRC7)."""
    of_statutes, of_judgments = chunk(spark, job)
    statutes, judgments = (read_or_empty(spark, f"{job.source}/{name}.parquet", CORPUS_TABLES[name]) for name in ("phapdien_unified", "anle_unified"))
    if model is None:
        entities, relations = (read_or_empty(spark, f"{job.source}/{name}.parquet", schema) for name, schema in MODEL_TABLES.items())
    else:
        entities, relations, _ = extract(spark, job, [of_statutes, of_judgments], model)
    nodes, edges = build_graph(of_statutes, of_judgments, statutes, judgments, entities, relations)
    write_table(nodes, job.target, "nodes", job.formats)
    write_table(edges, job.target, "edges", job.formats)
    return nodes, edges


def report_chunks(chunks: DataFrame) -> DataFrame:
    """Sizes per type of chunk (AGG9, AGG10)."""
    return size_statistics(chunks, "chunk_char_len", "chunk_type")
