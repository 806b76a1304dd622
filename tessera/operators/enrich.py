"""Flat statute and judgment tables out of raw records and their ontology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import path

STATUTE_STRINGS = (
    "doc_id", "article_id", "article_title", "chapter_title", "topic_id", "topic_title_vi", "topic_title_en", "topic_note", "subject_id",
    "subject_title_vi", "subject_title_en", "content_text", "source_note_text", "related_note_text", "source_links_json", "source_url",
    "hierarchy_path", "scraped_at", "metadata_json",
)
STATUTE_NUMBERS = ("topic_number", "subject_number", "content_char_len", "content_word_count")


def filled(df: DataFrame) -> DataFrame:
    """String nulls as '', whole numbers as 0, fractions as 0.0 (PRJ3); other types stay."""
    empty = {"string": F.lit(""), "bigint": F.lit(0).cast("long"), "int": F.lit(0), "double": F.lit(0.0)}
    return df.select(*[F.coalesce(F.col(c), empty[t]).alias(c) if t in empty else F.col(c) for c, t in df.dtypes])


def whole_number(column: str) -> Column:
    """A number out of any text: '3.7' is 3, what is no number is 0 (PRJ4)."""
    return F.coalesce(F.expr(f"try_cast(try_cast(`{column}` AS double) AS bigint)"), F.lit(0).cast("long"))


def last_per_key(dimension: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in ``order``; null and empty keys are dropped, keys become strings."""
    rows = dimension.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).withColumn(key, F.col(key).cast("string"))
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.col(order)).alias("_row")).select(key, "_row.*")


def with_ontology(articles: DataFrame, topics: DataFrame, subjects: DataFrame, order: str = "ord") -> DataFrame:
    """Titles and notes of topics and subjects joined to articles (JON1, JON2, JON3).

    A title of the ontology counts unless it is missing or empty; then the article's own does, else ''. Dimensions may repeat keys (the
    last in ``order`` counts); articles of unknown keys stay. Spark broadcasts a dimension where its size is below the threshold.
    """
    own = [c for c in articles.columns if c not in ("topic_title_vi", "topic_title_en", "topic_note", "subject_title_vi", "subject_title_en")]
    t = last_per_key(topics.select("topic_id", "topic_title_vi", "topic_title_en", "topic_note", order), "topic_id", order)
    s = last_per_key(subjects.select("subject_id", "subject_title_vi", "subject_title_en", order), "subject_id", order)
    t = t.select(F.col("topic_id").alias("_t"), *[F.col(c).alias(f"_{c}") for c in ("topic_title_vi", "topic_title_en", "topic_note")])
    s = s.select(F.col("subject_id").alias("_s"), *[F.col(c).alias(f"_{c}") for c in ("subject_title_vi", "subject_title_en")])
    joined = articles.join(t, F.col("topic_id").cast("string") == F.col("_t"), "left").join(s, F.col("subject_id").cast("string") == F.col("_s"), "left")
    first = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs], F.lit(""))
    return joined.select(
        *own,
        first("_topic_title_vi", "topic_title_vi").alias("topic_title_vi"),
        first("_topic_title_en").alias("topic_title_en"),
        first("_topic_note").alias("topic_note"),
        first("_subject_title_vi", "subject_title_vi").alias("subject_title_vi"),
        first("_subject_title_en").alias("subject_title_en"),
    )


def links_json(links: Column) -> Column:
    """array<struct<text,href>> as JSON, '[]' for null (JSN1)."""
    kept = F.transform(links, lambda x: F.struct(F.coalesce(x["text"], F.lit("")).alias("text"), F.coalesce(x["href"], F.lit("")).alias("href")))
    return F.coalesce(F.to_json(kept), F.lit("[]"))


def unified_statutes(enriched: DataFrame) -> DataFrame:
    """The 23 columns of a statute (PRJ1, STR11, JSN2), nulls filled."""
    meta = F.to_json(F.struct("article_id", "topic_id", "topic_number", "subject_id", "subject_number", "source_url"), {"ignoreNullFields": "false"})
    route = path(F.col("topic_title_vi"), F.col("subject_title_vi"), F.col("chapter_title"), F.col("article_title"))
    wide = enriched.withColumn("hierarchy_path", route).withColumn("metadata_json", meta)
    return filled(wide.select(*[F.col(c).cast("string") for c in STATUTE_STRINGS], *[F.col(c).cast("long") for c in STATUTE_NUMBERS]))


JUDGMENT_RENAMES = {"doc_name": "doc_id", "markdown": "content_markdown", "char_len": "content_char_len"}


def unified_judgments(raw: DataFrame) -> DataFrame:
    """The 32 columns of a judgment (PRJ2, JSN3): raw names are renamed, nulls filled; the text hash and the parser go into a JSON column
    where that is not there yet."""
    df = raw.withColumnsRenamed(JUDGMENT_RENAMES)
    if "metadata_json" not in df.columns:
        df = df.withColumn("metadata_json", F.to_json(F.struct("text_hash", "parser_model"), {"ignoreNullFields": "false"})).drop("text_hash", "parser_model")
    return filled(df)
