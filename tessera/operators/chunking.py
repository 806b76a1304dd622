"""Structural chunks of statutes and section chunks of judgments.

All but the recursive splitter are column expressions: a document is one row whose chunks are an array until the end, so statutes need
no shuffle and judgments one, on their document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import clean_lead, context_prefix, let, safe, section_prefix, strip, word_count

# What starts a clause, and where an oversized chunk may be split, the best place first.
CLAUSE_SPLIT = r"(?mdU)(?=^[1-9]\d?\.\s+.{15,})"
CLAUSE_START = r"(?dU)^[1-9]\d?\.\s+.{15,}"
SEPARATORS = ("\n\n", "\n", ". ", "; ", ", ", " ", "")
MAX_CHARS, OVERLAP, MIN_CHARS, LEAST_CHARS = 1000, 150, 80, 10
SECTIONS = ("case_summary", "findings", "decision")
STATUTE_META = ("doc_id", "article_id", "article_title", "chapter_title", "topic_id", "topic_title_vi", "subject_id", "subject_title_vi", "hierarchy_path", "source_url")
JUDGMENT_META = (
    "doc_id", "doc_code", "precedent_number", "title", "subject", "case_type", "doc_type", "year", "court_level", "jurisdiction",
    "applied_article_code", "applied_article_number", "applied_article_clause", "detail_url",
)


def clauses(text: Column) -> Column:
    """An article's clauses (STR1, STR2): what stands before the first is put before it with a line end; pieces are stripped; a text
    without clauses is one piece, an empty one none."""

    def gathered(pieces: Column) -> Column:
        lead, second = strip(F.try_element_at(pieces, F.lit(1))), strip(F.try_element_at(pieces, F.lit(2)))
        first = F.concat_ws("\n", F.filter(F.array(lead, second), lambda x: x != ""))
        others = F.slice(pieces, F.lit(3), F.greatest(F.size(pieces) - 2, F.lit(0)))
        whole = (F.size(pieces) < 2) | F.try_element_at(pieces, F.lit(1)).rlike(CLAUSE_START)
        return F.transform(F.when(whole, pieces).otherwise(F.concat(F.array(first), others)), strip)

    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(let(F.split(text, CLAUSE_SPLIT), gathered))


def merge_short(pieces: Column, least: int = MIN_CHARS) -> Column:
    """Pieces shorter than ``least`` go before the next with a line end, a trailing one after the last (STR3); one piece alone stays."""
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("carry"))

    def step(acc: Column, piece: Column) -> Column:
        text = F.when(acc["carry"] == "", piece).otherwise(F.concat(acc["carry"], F.lit("\n"), piece))
        short = F.length(text) < least
        return F.struct(F.when(short, acc["out"]).otherwise(F.concat(acc["out"], F.array(text))).alias("out"), F.when(short, text).otherwise(F.lit("")).alias("carry"))

    def finish(acc: Column) -> Column:
        last = F.concat(F.try_element_at(acc["out"], F.lit(-1)), F.lit("\n"), acc["carry"])
        back = F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(last))
        return F.when(acc["carry"] == "", acc["out"]).when(F.size(acc["out"]) == 0, F.array(acc["carry"])).otherwise(back)

    return let(pieces, lambda p: F.when(F.size(p) <= 1, p).otherwise(F.aggregate(p, state, step, finish)))


def split_recursively(text: str, limit: int = MAX_CHARS, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``limit`` characters, cut at the first separator that occurs, the separator at the head of what follows; parts
    that are still too long are cut at the next; neighbours are joined while they fit, repeating up to ``overlap`` characters."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    if separators[at] == "":
        parts = list(text)
    else:
        first, *others = text.split(separators[at])
        parts = [p for p in [first, *[separators[at] + o for o in others]] if p]
    out: list[str] = []
    fitting: list[str] = []
    for part in parts:
        if len(part) <= limit:
            fitting.append(part)
            continue
        out += _joined(fitting, limit, overlap)
        fitting = []
        out += split_recursively(part, limit, overlap, separators[at + 1 :]) if at + 1 < len(separators) else [part]
    return out + _joined(fitting, limit, overlap)


def _joined(parts: list[str], limit: int, overlap: int) -> list[str]:
    out, window, size = [], [], 0
    for part in parts:
        if window and size + len(part) > limit:
            out.append("".join(window).strip())
            while window and (size > overlap or size + len(part) > limit):
                size -= len(window.pop(0))
        window.append(part)
        size += len(part)
    return [p for p in [*out, "".join(window).strip()] if p]


@F.pandas_udf(T.ArrayType(T.StringType()))
def recursive_pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``split_recursively`` with the standard sizes (STR5); null stays null."""
    for batch in texts:
        yield batch.map(split_recursively, na_action="ignore")


def _chunk_rows(df: DataFrame, prefix: Column, identity: Column, meta: list[Column]) -> DataFrame:
    """Explodes ``chunks`` (array of text and type) into rows with ordinals, totals, ids and lengths (ARR1, WIN1, STR14-16, AGG16)."""
    rows = df.select("*", F.size("chunks").cast("long").alias("chunk_total"), F.posexplode_outer("chunks").alias("_at", "_chunk")).where("_chunk IS NOT NULL")  # as a plain generator, it would be computed twice
    return rows.select(
        F.concat(identity, F.lit("::chunk::"), F.col("_at")).alias("chunk_id"),
        F.col("_at").cast("long").alias("chunk_index"),
        "chunk_total",
        F.col("_chunk.kind").alias("chunk_type"),
        F.col("_chunk.text").alias("chunk_text"),
        F.concat(prefix, F.col("_chunk.text")).alias("embed_text"),
        F.length("_chunk.text").cast("long").alias("chunk_char_len"),
        word_count(F.col("_chunk.text")).alias("chunk_word_count"),
        *meta,
    )


def statute_chunks(articles: DataFrame) -> DataFrame:
    """The 18 columns of statute chunks: an article is cut at its clauses, short ones are merged, long ones split.

    Nulls count as ''; an empty text and the literal 'nan' make no chunk (FLT1). An article of several clauses gives 'khoan', of one
    'full', an oversized clause 'split' chunks, whose second and later pieces bear the clause's number (STR7, STR8); of its pieces those
    under ten characters are dropped unless all are (FLT3). Repeated rows give repeated chunks; no shuffle.
    """
    text = safe(F.col("content_text"))
    rows = articles.select(*[safe(F.col(c)).alias(c) for c in STATUTE_META], text.alias("_text")).where(~F.col("_text").isin("", "nan"))
    rows = rows.withColumn("_clauses", merge_short(clauses(F.col("_text"))))
    long = lambda c: F.length(c) > MAX_CHARS
    # Only oversized clauses go to Python, each in its place, so that the article stays one row.
    cut = rows.withColumn("_cut", _split_all(F.when(F.exists("_clauses", long), F.transform("_clauses", lambda c: F.when(long(c), c)))))
    kind = F.when(F.size("_clauses") > 1, "khoan").otherwise("full")

    def pieces(clause: Column, i: Column) -> Column:
        head = F.regexp_extract(clause, r"(?U)^(\d+\.\s+)", 1)
        cleaned = F.filter(F.transform(F.get(F.col("_cut"), i), clean_lead), lambda p: F.length(p) >= LEAST_CHARS)
        kept = let(cleaned, lambda c: F.when(F.size(c) == 0, F.array(clause)).otherwise(c))
        marked = F.transform(kept, lambda p, n: F.when((n == 0) | (head == ""), p).otherwise(F.concat(F.lit("[..."), strip(head), F.lit("] "), p)))
        split = F.transform(marked, lambda p: F.struct(p.alias("text"), F.lit("split").alias("kind")))
        return F.when(long(clause), split).otherwise(F.array(F.struct(clause.alias("text"), kind.alias("kind"))))

    cut = cut.withColumn("chunks", F.flatten(F.transform("_clauses", pieces)))
    prefix = context_prefix(F.col("topic_title_vi"), F.col("subject_title_vi"), F.col("chapter_title"), F.col("article_title"))
    identity = F.concat(F.col("doc_id"), F.lit("::"), F.col("article_id"))
    return _chunk_rows(cut.withColumn("_prefix", prefix), F.col("_prefix"), identity, [F.col(c) for c in STATUTE_META])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _split_all(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda clauses: [None if c is None else split_recursively(c) for c in clauses], na_action="ignore")


def paragraphs(sentences: DataFrame) -> DataFrame:
    """(doc_name, paragraphs): per document the array of its paragraphs (at, kind, section, text), in the order in which they begin.

    Sentences (doc_name, paragraph_id, section_kind, paragraph_kind, index_in_paragraph, global_index, text) of one paragraph and section
    are joined by their index with blanks and cleaned at the head (AGG11, AGG12, SRT2, WIN5); empty paragraphs are dropped (FLT10), and
    sentences without document, paragraph or section.
    """
    rows = sentences.where("doc_name IS NOT NULL AND paragraph_id IS NOT NULL AND section_kind IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct("index_in_paragraph", "global_index", F.coalesce("text", F.lit("")).alias("text"))))
    whole = rows.groupBy("doc_name", "paragraph_id", "section_kind").agg(
        clean_lead(F.concat_ws(" ", F.transform(ordered, lambda s: s["text"]))).alias("text"),
        F.min("global_index").alias("at"),
        F.min_by("paragraph_kind", "index_in_paragraph").alias("kind"),
    )
    each = F.struct("at", "paragraph_id", F.col("section_kind").alias("section"), "kind", "text")
    return whole.where("text != ''").groupBy("doc_name").agg(F.array_sort(F.collect_list(each)).alias("paragraphs"))


_PIECES = "array<struct<text:string,section:string>>"


def pack_sections(found: Column, limit: int = MAX_CHARS, keep_all: bool = False) -> Column:
    """Neighbouring paragraphs of one section, joined by line ends while they fit (STR10, WIN4, FLT2).

    Other sections are skipped without ending a run. A run that begins with the document counts a line end for its first paragraph too,
    so its limit is one less.
    """
    section = F.try_element_at(found, F.lit(1))["section"]
    state = F.struct(F.array().cast(_PIECES).alias("out"), F.lit("").alias("text"), section.alias("section"), F.lit(0).alias("n"), F.lit(False).alias("some"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["some"], F.concat(acc["out"], F.array(F.struct(acc["text"].alias("text"), acc["section"].alias("section"))))).otherwise(acc["out"])

    def step(acc: Column, p: Column) -> Column:
        size = F.length(p["text"])
        joins = (p["section"] == acc["section"]) & (acc["n"] + size + 1 <= limit)
        grown = F.when(acc["some"], F.concat(acc["text"], F.lit("\n"), p["text"])).otherwise(p["text"])
        return F.struct(
            F.when(joins, acc["out"]).otherwise(flushed(acc)).alias("out"),
            F.when(joins, grown).otherwise(p["text"]).alias("text"),
            F.when(joins, acc["section"]).otherwise(p["section"]).alias("section"),
            F.when(joins, acc["n"] + size + 1).otherwise(size).alias("n"),
            F.lit(True).alias("some"),
        )

    kept = found if keep_all else F.filter(found, lambda p: p["section"].isin(*SECTIONS))
    return F.aggregate(kept, state, step, flushed)


def merge_short_sections(pieces: Column, least: int = MIN_CHARS) -> Column:
    """As ``merge_short``: a short piece takes the section of the next, a trailing one that of the last (STR4)."""
    state = F.struct(F.array().cast(_PIECES).alias("out"), F.lit("").alias("carry"), F.lit("").alias("section"))

    def step(acc: Column, p: Column) -> Column:
        text = F.when(acc["carry"] == "", p["text"]).otherwise(F.concat(acc["carry"], F.lit("\n"), p["text"]))
        short = F.length(text) < least
        piece = F.struct(text.alias("text"), p["section"].alias("section"))
        return F.struct(F.when(short, acc["out"]).otherwise(F.concat(acc["out"], F.array(piece))).alias("out"), F.when(short, text).otherwise(F.lit("")).alias("carry"), p["section"].alias("section"))

    def finish(acc: Column) -> Column:
        last = F.try_element_at(acc["out"], F.lit(-1))
        joined = F.struct(F.concat(last["text"], F.lit("\n"), acc["carry"]).alias("text"), last["section"].alias("section"))
        back = F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(joined))
        alone = F.array(F.struct(acc["carry"].alias("text"), acc["section"].alias("section")))
        return F.when(acc["carry"] == "", acc["out"]).when(F.size(acc["out"]) == 0, alone).otherwise(back)

    return let(pieces, lambda p: F.when(F.size(p) <= 1, p).otherwise(F.aggregate(p, state, step, finish)))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("section", T.StringType())])))
def _split_sections(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda pieces: [{"text": t, "section": p["section"]} for p in pieces for t in (split_recursively(p["text"]) if len(p["text"]) > MAX_CHARS else [p["text"]])], na_action="ignore")


def judgment_chunks(judgments: DataFrame, sentences: DataFrame, keep_all: bool = False) -> DataFrame:
    """The 22 columns of judgment chunks: paragraphs are packed within their section, short packs merged, long ones split (STR9).

    A legal principle becomes the first chunk of a document that has others; their ids keep their ordinals (ARR2, WIN2). Documents
    without sentences make no chunk (JON4). Nulls count as ''. One shuffle of the sentences on the paragraph, one on the document.
    """
    numbers = ("year", "applied_article_number", "applied_article_clause")
    meta = [(F.coalesce(F.col(c).cast("long"), F.lit(0)) if c in numbers[:2] else safe(F.col(c))).alias(c) for c in JUDGMENT_META]
    found = paragraphs(sentences).withColumnRenamed("doc_name", "_doc")
    rows = judgments.select(*meta, safe(F.col("principle_text")).alias("_principle")).join(found, F.col("doc_id") == F.col("_doc"))
    packed = rows.withColumn("_packed", merge_short_sections(pack_sections(F.col("paragraphs"), keep_all=keep_all)))
    long = F.exists("_packed", lambda p: F.length(p["text"]) > MAX_CHARS)
    cut = packed.withColumn("_cut", _split_sections(F.when(long, F.col("_packed"))))
    cleaned = F.filter(F.transform("_cut", lambda p: F.struct(clean_lead(p["text"]).alias("text"), p["section"].alias("section"))), lambda p: F.length(p["text"]) >= LEAST_CHARS)
    pieces = cut.withColumn("_pieces", F.coalesce(cleaned, F.col("_packed"))).where(F.size("_pieces") > 0)
    own = F.transform("_pieces", lambda p, i: F.struct(p["text"].alias("text"), p["section"].alias("kind"), i.cast("string").alias("name")))
    first = F.array(F.struct(F.col("_principle").alias("text"), F.lit("principle").alias("kind"), F.lit("principle").alias("name")))
    listed = pieces.withColumn("chunks", F.when(F.col("_principle") != "", F.concat(first, own)).otherwise(own))
    out = listed.select("*", F.size("chunks").cast("long").alias("chunk_total"), F.posexplode_outer("chunks").alias("_at", "_chunk")).where("_chunk IS NOT NULL")
    prefix = section_prefix(F.col("case_type"), F.col("title"), F.col("subject"), F.col("_chunk.kind"))
    lead = F.when(F.col("_chunk.kind") == "principle", F.lit("[Nguyên tắc pháp lý] ")).otherwise("")
    return out.select(
        F.concat("doc_id", F.lit("::chunk::"), "_chunk.name").alias("chunk_id"),
        F.col("_at").cast("long").alias("chunk_index"),
        "chunk_total",
        F.col("_chunk.kind").alias("chunk_type"),
        F.col("_chunk.text").alias("chunk_text"),
        F.concat(lead, prefix, F.col("_chunk.text")).alias("embed_text"),
        F.length("_chunk.text").cast("long").alias("chunk_char_len"),
        word_count(F.col("_chunk.text")).alias("chunk_word_count"),
        *JUDGMENT_META,
    )


def sentences_of(judgments: DataFrame) -> DataFrame:
    """The sentence table of judgments, out of their text: lines are paragraphs, headings open sections, marks end sentences.

    For judgments that come without a sentence table. Sections follow the order of the headings: before the first 'header', then
    'case_summary', 'findings', 'decision'. One row per document is read, the smallest text of a repeated doc_id.
    """
    one = judgments.where("doc_id IS NOT NULL AND content_markdown != ''").groupBy("doc_id").agg(F.min("content_markdown").alias("_text"))
    headed = F.col("_text").rlike(r"^##\s").cast("int")  # then there is nothing before the first heading
    rows = one.select(F.col("doc_id").alias("doc_name"), headed.alias("_first"), F.posexplode_outer(F.split("_text", r"(?m)(?=^##\s)")).alias("_section", "_part"))
    rows = rows.select("doc_name", (F.col("_section") + F.col("_first")).alias("_section"), F.posexplode_outer(F.split("_part", r"\r\n|[\r\n]")).alias("_line", "_text"))
    rows = rows.where(~F.col("_text").rlike(r"^#")).withColumn("_text", strip(F.col("_text"))).where("_text != ''")
    kinds = F.array(*map(F.lit, ("header", *SECTIONS, "footer")))
    kind = F.element_at(kinds, F.least(F.col("_section") + 1, F.lit(5)))
    rows = rows.select("doc_name", "_section", "_line", kind.alias("section_kind"), F.posexplode_outer(F.split("_text", r"(?<=[.!?])\s+")).alias("index_in_paragraph", "text"))
    return rows.select(
        "doc_name",
        F.concat_ws(".", F.lit("p"), "_section", "_line").alias("paragraph_id"),
        "section_kind",
        F.when(F.col("text").rlike(r"^\d+[.)]\s"), "list_item").otherwise("text").alias("paragraph_kind"),
        F.col("index_in_paragraph").cast("long"),
        ((F.col("_section").cast("long") * 1_000_000 + F.col("_line")) * 100_000 + F.col("index_in_paragraph")).alias("global_index"),
        "text",
    )
