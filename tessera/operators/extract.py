"""Entities and relations out of chunks and links, by rule and by a pluggable model."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import context_of, entity_id, strip

# What is looked for. (?iU) folds case and reads classes as Unicode does.
PATTERNS = {
    "VBPL": r"(?iU)(?:Bộ luật|Luật|Nghị định|Nghị quyết|Pháp lệnh|Thông tư liên tịch|Thông tư|Quyết định)\s+(?:số\s+)?\d+[\w.\-]*/[\w.\-/]+",
    "DIEU": r"(?iU)(?:khoản\s+\d+[a-z]?\s+)?Điều\s+\d+[a-z]?",
    "KHUNG_HINH_PHAT": r"(?iU)(?:phạt\s+)?(?:tù|cải tạo không giam giữ|cảnh cáo|phạt tiền)[\s\w]+(?:năm|tháng|triệu|tỷ)",
}
# What a match of a pattern contains, in lower case; texts without any of it need no search.
HINTS = {"VBPL": ("/",), "DIEU": ("điều",), "KHUNG_HINH_PHAT": ("tù", "cải tạo không giam giữ", "cảnh cáo", "phạt tiền")}
LAW_NAME = r"(?iU)(Bộ luật|Luật|Pháp lệnh|Nghị quyết|Nghị định|Thông tư liên tịch|Thông tư|Quyết định)\s+(?:số\s+)?([\w/.\-]+)"
ITEM_ID = r"ItemID=(\d+)"
# What tells that a text states a relation, and the kinds of entities and relations.
SIGNALS = r"(?iU)sửa đổi|bổ sung|thay thế|bãi bỏ|hết hiệu lực|hướng dẫn thi hành|quy định chi tiết|theo quy định tại|căn cứ\s|dẫn chiếu|được quy định tại"
ENTITY_TYPES = ("VBPL", "DIEU", "CO_QUAN", "KHUNG_HINH_PHAT", "LINH_VUC", "THOI_GIAN", "CHU_THE")
RELATION_TYPES = ("TRICH_DAN", "SUA_DOI", "HUONG_DAN", "THAY_THE", "LIEN_QUAN", "THUOC")

LINKS = "array<struct<text:string,href:string>>"
RESULT = "struct<entities:array<struct<name:string,type:string>>,relations:array<struct<source:string,target:string,type:string>>>"


def entities_in(text: Column, patterns: dict[str, str] = PATTERNS) -> Column:
    """array<struct<type,name>>: every match of each pattern, trimmed, without trailing marks, each (type, name) once (STR17-20, AGG14).
    Ordered by pattern, then by first match. Null gives an empty array. A pattern is only searched in texts that hold one of its hints,
    for folding case at every position is what costs."""
    lower, none = F.lower(text), F.array().cast("array<struct<type:string,name:string>>")
    hinted = {kind: reduce(Column.__or__, [F.contains(lower, F.lit(h)) for h in HINTS[kind]]) if kind in HINTS else F.lit(True) for kind in patterns}
    found = [F.when(hinted[kind], _matches(text, kind, pattern)).otherwise(none) for kind, pattern in patterns.items()]
    return F.coalesce(F.array_distinct(F.filter(F.concat(*found), lambda e: e["name"] != "")), none)


def _matches(text: Column, kind: str, pattern: str) -> Column:
    trimmed = lambda m: F.regexp_replace(strip(m), r"[ .,;:\"]+$", "")
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("type"), trimmed(m).alias("name")))


def rule_entities(chunks: DataFrame) -> DataFrame:
    """(chunk_id, type, name, entity_id) of every entity that the rules find in a chunk's text; no shuffle."""
    # The outer form and a filter behind it: a plain generator would have the search run twice, once to test for an empty array.
    found = chunks.select("chunk_id", F.inline_outer(entities_in(F.col("chunk_text")))).where("name IS NOT NULL")
    return found.withColumn("entity_id", entity_id(F.col("type"), F.col("name")))


def law_links(statutes: DataFrame) -> DataFrame:
    """(doc_id, item_id, name, url) of every usable link in ``source_links_json`` (JSN4, FLT6, STR22, STR23): it has an ItemID and its
    text names a law. Null or empty ids, null, broken and other JSON give none; repeated links stay."""
    rows = statutes.where("doc_id != ''").select("doc_id", F.inline_outer(F.from_json("source_links_json", LINKS)))
    named = rows.select("doc_id", F.regexp_extract("href", ITEM_ID, 1).alias("item_id"), F.regexp_extract("text", LAW_NAME, 1).alias("kind"), F.regexp_extract("text", LAW_NAME, 2).alias("number"), F.col("href").alias("url"))
    return named.where("item_id != '' AND kind != ''").select("doc_id", "item_id", F.concat_ws(" số ", "kind", "number").alias("name"), "url")


def applied_articles(judgments: DataFrame) -> DataFrame:
    """(doc_id, entity_id, name) of the article that a judgment applies; '0', 'nan' and '' are none (FLT7)."""
    number = F.coalesce(F.col("applied_article_number").cast("string"), F.lit(""))
    name = F.concat(F.lit("Điều "), number)
    return judgments.where(~number.isin("0", "nan", "")).select("doc_id", entity_id(F.lit("DIEU"), name).alias("entity_id"), name.alias("name"))


def has_signal(text: Column) -> Column:
    """Whether a text may state a relation (FLT4); null does not."""
    return F.coalesce(text.rlike(SIGNALS), F.lit(False))


def fill_prompt(template: str, context: str, content: str) -> str:
    """A prompt with its two places filled (SRC9, STR25). The fixed part of the template stays in front, where a server can cache it."""
    return template.replace("{context}", context).replace("{content}", content)


def to_extract(chunks: DataFrame, done: DataFrame, most: int = 4000, sample_size: int | None = None) -> DataFrame:
    """(chunk_id, part, context, content) of chunks with a signal that are not done yet (JON5, FLT4, FLT5, STR24, STR25). The cheap filter
    runs before the join, and both before any model.

    A model takes at most ``most`` characters; longer content comes in several parts, numbered from 0. ``sample_size`` takes the first
    chunks by id, before any filter (SRT3).
    """
    sampled = chunks if sample_size is None else chunks.orderBy("chunk_id").limit(sample_size)
    rows = sampled.where(has_signal(F.col("chunk_text"))).join(done.select("chunk_id").distinct(), "chunk_id", "left_anti")
    context = strip(context_of(F.col("embed_text"), F.col("chunk_text")))
    starts = F.sequence(F.lit(0), F.greatest(F.length("chunk_text") - 1, F.lit(0)), F.lit(most))
    parts = rows.select("chunk_id", F.when(context == "", "(không có)").otherwise(context).alias("context"), "chunk_text", F.posexplode(starts).alias("part", "_start"))
    return parts.select("chunk_id", "part", "context", F.substring("chunk_text", F.col("_start") + 1, F.lit(most)).alias("content"))


def result_schema() -> dict:
    """The JSON Schema of an answer, for servers that guide a model by it (JSN7)."""
    text = {"type": "string"}
    listed = lambda fields: {"type": "array", "items": {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}}
    fields = {
        "entities": listed({"name": text, "type": {"enum": list(ENTITY_TYPES)}}),
        "relations": listed({"source": text, "target": text, "type": {"enum": list(RELATION_TYPES)}}),
    }
    return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}


@dataclass(frozen=True)
class Endpoint:
    """Where a model is served."""

    url: str
    model: str
    key: str = ""
    seconds: float = 120.0


def configured_endpoint(spark: SparkSession) -> Endpoint:
    """The endpoint in the session's settings tessera.model.url, .name and .key; each falls back to an environment variable (SRC10)."""
    setting = lambda name, variable, default="": spark.conf.get(f"tessera.model.{name}", os.environ.get(variable, default))
    url = setting("url", "MODEL_URL")
    if not url:
        raise ValueError("set tessera.model.url or MODEL_URL")
    return Endpoint(url, setting("name", "MODEL_NAME", "default"), setting("key", "MODEL_KEY"))


def served_model(endpoint: Endpoint) -> Callable[[str, int], tuple[str, bool]]:
    """Asks a chat-completions server, at temperature 0 and guided by the result's schema (UDF1): (prompt, budget) to (text, ended)."""

    def ask(prompt: str, budget: int) -> tuple[str, bool]:
        guided = {"type": "json_schema", "json_schema": {"name": "result", "schema": result_schema()}}
        body = {"model": endpoint.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0, "max_tokens": budget, "response_format": guided}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {endpoint.key}"} if endpoint.key else {})
        request = urllib.request.Request(f"{endpoint.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=endpoint.seconds) as answer:
            choice = json.load(answer)["choices"][0]
        return choice["message"]["content"], choice["finish_reason"] == "stop"

    return ask


def prompted(ask: Callable[[str, int], tuple[str, bool]], template: str) -> Model:
    """A model out of one that takes whole prompts: the template's places are filled for every part."""
    return lambda context, content, budget: ask(fill_prompt(template, context, content), budget)


#: A model: (context, content, token budget) to (JSON text, whether it ended by itself).
Model = Callable[[str, str, int], tuple[str, bool]]


def _ask(model: Model, context: str, content: str, budget: int) -> tuple[str | None, str | None, int]:
    """(JSON, error, attempts): one retry with twice the budget after a cut or broken answer (UDF2)."""
    error = None
    for attempt in (1, 2):
        try:
            text, ended = model(context, content, budget * attempt)
            if ended and isinstance(json.loads(text), dict):
                return text, None, attempt
            error = "cut off" if not ended else "not an object"
        except Exception as problem:  # a model may fail in any way; the row is reported, not the job ended
            error = f"{type(problem).__name__}: {problem}"
    return None, error, 2


def extract_with_model(todo: DataFrame, model: Model, concurrency: int = 8, budget: int = 1024) -> DataFrame:
    """(chunk_id, part, result, error, attempts) for (chunk_id, part, context, content): a bounded number of calls at a time in each task
    (UDF1-3).

    Results are parsed against the schema; entities of unknown type and relations of unknown type are dropped (JSN5, FLT9). A failed
    row has a null result and an error, so that a later run asks again (UDF9). Tasks may be retried: the model is called at least once.
    """
    schema = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("raw", T.StringType()), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                answers = list(pool.map(lambda row: _ask(model, row[0], row[1], budget), zip(batch["context"], batch["content"])))
                yield pd.DataFrame([(i, n, *a) for i, n, a in zip(batch["chunk_id"], batch["part"], answers)], columns=["chunk_id", "part", "raw", "error", "attempts"])

    asked = todo.select("chunk_id", "part", "context", "content").mapInPandas(ask, schema)
    parsed = F.from_json("raw", RESULT)
    entities = F.filter(parsed["entities"], lambda e: e["name"].isNotNull() & e["type"].isin(*ENTITY_TYPES))
    relations = F.filter(parsed["relations"], lambda r: r["source"].isNotNull() & r["target"].isNotNull() & r["type"].isin(*RELATION_TYPES))
    result = F.when(F.col("raw").isNotNull(), F.struct(entities.alias("entities"), relations.alias("relations")))
    return asked.select("chunk_id", "part", result.alias("result"), "error", "attempts")


def failures(results: DataFrame) -> DataFrame:
    """(error, n): how many rows failed, by the first words of their error (AGG17, UDF9); one row of null for those that did not."""
    return results.groupBy(F.substring_index("error", ":", 1).alias("error")).agg(F.count("*").alias("n"))


def overlaid(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Results (chunk_id, part, result) of an earlier and a later run; where both have a chunk, the later counts (JON6)."""
    kept = earlier.join(later.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return kept.select("chunk_id", "part", "result").unionByName(later.select("chunk_id", "part", "result"))


def flat_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) out of (chunk_id, part, result) as ``extract_with_model`` gives it: one row per item, numbered by its part and
    its place in the result, as ``resolved_relations`` and ``build_graph`` read them. Of repeated chunks each item counts once."""
    key = F.concat_ws("/", "chunk_id", F.lpad(F.col("part").cast("string"), 6, "0"), F.lpad(F.col("at").cast("string"), 9, "0"))
    entities = results.select("chunk_id", "part", F.posexplode("result.entities").alias("at", "e")).select(key.alias("mention_id"), "chunk_id", "e.name", "e.type")
    relations = results.select("chunk_id", "part", F.posexplode("result.relations").alias("at", "r")).select(key.alias("relation_id"), "chunk_id", "r.source", "r.target", "r.type")
    return entities.distinct(), relations.distinct()


def resolved_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(relation_id, chunk_id, source_id, target_id, type) of relations both of whose ends name an entity of their chunk (JON7, FLT9).

    Names are compared in lower case and trimmed; of entities with one name the last mention counts. Ends that are null, empty or name
    nothing and relations without type drop out. Repeated rows come out once. Entities are reduced to one row per chunk and name, so
    neither join multiplies rows.
    """
    key = lambda c: F.lower(F.trim(c))
    named = entities.where("name IS NOT NULL AND type IS NOT NULL AND chunk_id IS NOT NULL")
    named = named.groupBy("chunk_id", key("name").alias("k")).agg(F.max_by(entity_id(F.col("type"), F.col("name")), "mention_id").alias("entity_id"))
    side = lambda name: named.select("chunk_id", F.col("k").alias(f"{name}_k"), F.col("entity_id").alias(f"{name}_id"))
    rows = relations.where("type != ''").select("relation_id", "chunk_id", "type", key("source").alias("source_k"), key("target").alias("target_k")).distinct()
    both = rows.join(side("source"), ["chunk_id", "source_k"]).join(side("target"), ["chunk_id", "target_k"])
    return both.select("relation_id", "chunk_id", "source_id", "target_id", "type")
