"""Nodes and edges: building, merging, checking and walking the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import entity_id
from tessera.operators.extract import applied_articles, law_links, resolved_relations, rule_entities


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def _node(identity: Column, label: str, properties: Column, stage: int, order: Column) -> list[Column]:
    return [identity.alias("id"), F.lit(label).alias("label"), properties.alias("properties"), F.lit(stage).alias("stage"), order.cast("string").alias("ord")]


def _edge(source: Column, target: Column, kind: str, properties: Column | None = None) -> list[Column]:
    return [source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("type"), (F.lit("{}") if properties is None else properties).alias("properties")]


def first_writer_wins(candidates: DataFrame) -> DataFrame:
    """One node per id: of (id, label, properties, stage, ord) the first stage's first row (AGG13). Partial aggregation keeps a hot id small."""
    first = F.min(F.struct("stage", "ord", "label", "properties"))
    return candidates.where("id IS NOT NULL").groupBy("id").agg(first.alias("_n")).select("id", "_n.label", "_n.properties")


def model_results(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidate nodes, edges) of what a model found (UDF7, JON7, SET1): mentions (mention_id, chunk_id, name, type) and relations
    (relation_id, chunk_id, source, target, type).

    A mention with a name and a type gives its ENTITY and one MENTIONS edge; a relation both of whose ends are named in its chunk gives
    one edge of its type. Results are applied once, so repeated rows count once.
    """
    named = entities.where("chunk_id IS NOT NULL AND name != '' AND type != ''").select("mention_id", "chunk_id", "name", "type").distinct()
    identity = entity_id(F.col("type"), F.col("name"))
    about = _json(name=F.col("name"), entity_type=F.col("type"), source=F.lit("llm"))
    nodes = named.select(*_node(identity, "ENTITY", about, 3, F.concat_ws("/", "chunk_id", "mention_id")))
    origin = _json(source=F.lit("llm"), from_chunk=F.col("chunk_id"))
    related = resolved_relations(relations, named).select("source_id", "target_id", "type", origin.alias("properties"))
    return nodes, named.select(*_edge(F.col("chunk_id"), identity, "MENTIONS")).unionByName(related)


def build_graph(
    statute_chunks: DataFrame, judgment_chunks: DataFrame, statutes: DataFrame, judgments: DataFrame, entities: DataFrame | None = None, relations: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of both corpora (SET1, SNK6): chunks, their articles or judgments, the entities that rules, metadata and links name,
    and, with ``entities`` and ``relations``, what a model found.

    Nodes are one per id, the first writer's; edges are a bag, as they are found: a law linked twice has two edges, an article applied by
    a judgment one edge per chunk. Empty inputs give empty tables.
    """
    nodes, edges = [], []
    for stage, (chunks, label, source) in enumerate(((statute_chunks, "ARTICLE", "phapdien"), (judgment_chunks, "AN_LE", "anle"))):
        order = F.concat_ws("/", "doc_id", F.lpad(F.col("chunk_index"), 9, "0"))
        own = _json(text=F.col("chunk_text"), embed_text=F.col("embed_text"), chunk_type=F.col("chunk_type"), source=F.lit(source))
        parent = (
            _json(article_id=F.col("article_id"), title=F.col("article_title"), chapter=F.col("chapter_title"), topic=F.col("topic_title_vi"), subject=F.col("subject_title_vi"))
            if label == "ARTICLE"
            else _json(title=F.col("title"), case_type=F.col("case_type"), year=F.col("year"))
        )
        found = rule_entities(chunks)
        entity = _json(name=F.col("name"), entity_type=F.col("type"), source=F.lit("regex"))
        nodes += [chunks.select(*_node(F.col("chunk_id"), "CHUNK", own, stage, order)), chunks.select(*_node(F.col("doc_id"), label, parent, stage, order)), found.select(*_node(F.col("entity_id"), "ENTITY", entity, stage, F.col("chunk_id")))]
        edges += [chunks.select(*_edge(F.col("chunk_id"), F.col("doc_id"), "BELONGS_TO")), found.select(*_edge(F.col("chunk_id"), F.col("entity_id"), "MENTIONS"))]
    applied = applied_articles(judgments.dropDuplicates(["doc_id"])).join(judgment_chunks.select("doc_id", "chunk_id"), "doc_id")
    nodes.append(applied.select(*_node(F.col("entity_id"), "ENTITY", _json(name=F.col("name"), entity_type=F.lit("DIEU"), source=F.lit("metadata")), 1, F.col("doc_id"))))
    edges.append(applied.select(*_edge(F.col("doc_id"), F.col("entity_id"), "APPLIES_ARTICLE")))
    links = law_links(statutes)
    law = F.concat(F.lit("VBPL::"), "item_id")
    about = _json(name=F.col("name"), entity_type=F.lit("VBPL"), source=F.lit("source_links"), url=F.col("url"))
    nodes.append(links.select(*_node(law, "ENTITY", about, 2, F.col("doc_id"))))
    edges.append(links.select(*_edge(F.col("doc_id"), law, "THUOC", F.lit('{"via":"source_links"}'))))
    if entities is not None and relations is not None:
        for found, kept in zip(model_results(entities, relations), (nodes, edges)):
            kept.append(found)
    return first_writer_wins(reduce(DataFrame.unionByName, nodes)), reduce(DataFrame.unionByName, edges)


def merged_properties(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per ``keys``: ``properties``, a JSON object of every property that a row of the group has, with the value that comes last in
    ``order`` and then in the text of its row; and ``n_rows``. New properties are added, known ones replaced. Names are sorted; values
    keep their JSON types. What is no object adds nothing; a group without any gives '{}'. A group holds as many entries as there are names.
    """
    names = ", ".join(f"`{k}`" for k in keys)
    ranked = rows.withColumn("_ord", F.struct(*order, "properties"))
    each = rows.sparkSession.sql(
        f"SELECT {names}, _ord, p.key AS _name, to_json(p.value) AS _value FROM {{rows}}, LATERAL variant_explode(CASE WHEN properties LIKE '{{{{%' THEN try_parse_json(properties) END) AS p", rows=ranked
    )
    last = each.groupBy(*keys, "_name").agg(F.max_by("_value", "_ord").alias("_value"))
    named = F.concat(F.regexp_extract(F.to_json(F.array("_name")), r"(?s)^\[(.*)\]$", 1), F.lit(":"), F.col("_value"))
    objects = last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_name"), named.alias("_pair")))).alias("_all"))
    text = F.concat(F.lit("{"), F.array_join(F.transform("_all", lambda x: x["_pair"]), ","), F.lit("}"))
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    return counted.join(objects.select(*keys, text.alias("properties")), keys, "left").select(*keys, F.coalesce("properties", F.lit("{}")).alias("properties"), "n_rows")


def merged_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """One row per (id, label) with its merged properties (SNK8). A null id or label is no node."""
    return merged_properties(nodes.where("id IS NOT NULL AND label IS NOT NULL"), ["id", "label"], [order]).drop("n_rows")


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes (JON8); repeated edges stay."""
    ids = nodes.where("id IS NOT NULL").select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def merged_edges(edges: DataFrame, nodes: DataFrame, order: list[str]) -> DataFrame:
    """One row per (source_id, target_id, type) with both ends, its merged properties and the number of its rows (SNK9)."""
    return merged_properties(with_both_ends(edges, nodes).where("type IS NOT NULL"), ["source_id", "target_id", "type"], order)


def repeated_ids(nodes: DataFrame) -> DataFrame:
    """(label, id, n) of ids with several rows: what a uniqueness constraint would reject (SNK10)."""
    return nodes.groupBy("label", "id").agg(F.count("*").alias("n")).where("n > 1")


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, the most frequent first, equals by value (AGG9, AGG15, SRT5)."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def one_hop(nodes: DataFrame, edges: DataFrame, label: str, kind: str) -> DataFrame:
    """(source_id, target_id, n): edges of a kind from nodes of a label to nodes (JON9)."""
    starts = nodes.where(F.col("label") == label).select(F.col("id").alias("source_id")).distinct()
    ends = nodes.where("id IS NOT NULL").select(F.col("id").alias("target_id")).distinct()
    walked = edges.where(F.col("type") == kind).join(starts, "source_id", "left_semi").join(ends, "target_id", "left_semi")
    return walked.groupBy("source_id", "target_id").agg(F.count("*").alias("n"))


def two_hops(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(start_id, end_id) that an edge of the first and then one of the second kind join (JON10); each pair once. Edges are reduced to
    distinct pairs before the join, whose hot middles AQE splits."""
    a = edges.where((F.col("type") == first) & (F.col("target_id") != "")).select(F.col("source_id").alias("start_id"), F.col("target_id").alias("middle")).distinct()
    b = edges.where((F.col("type") == second) & (F.col("target_id") != "")).select(F.col("source_id").alias("middle"), F.col("target_id").alias("end_id")).distinct()
    return a.join(b, "middle").select("start_id", "end_id").distinct()


def hierarchy_edges(statutes: DataFrame) -> DataFrame:
    """Edges (source_id, target_id, type) from topics to subjects (HAS_SUBJECT) and from subjects to articles (HAS_ARTICLE), each once
    (RET5). Missing or empty ids make no edge."""
    ids = statutes.select("topic_id", "subject_id", "doc_id")
    topic, subject = F.concat(F.lit("TOPIC::"), "topic_id"), F.concat(F.lit("SUBJECT::"), "subject_id")
    upper = ids.where("topic_id != '' AND subject_id != ''").select(topic.alias("source_id"), subject.alias("target_id"), F.lit("HAS_SUBJECT").alias("type"))
    lower = ids.where("subject_id != '' AND doc_id != ''").select(subject.alias("source_id"), F.col("doc_id").alias("target_id"), F.lit("HAS_ARTICLE").alias("type"))
    return upper.unionByName(lower).distinct()


def tree_edges(tree: DataFrame, child: str = "id", parent: str = "parent_id") -> DataFrame:
    """HAS_CHILD edges of a table of tree nodes, each once (RET5); roots have a missing or empty parent."""
    rows = tree.where((F.col(child) != "") & (F.col(parent) != ""))
    return rows.select(F.col(parent).alias("source_id"), F.col(child).alias("target_id"), F.lit("HAS_CHILD").alias("type")).distinct()


def glossary_edges(chunks: DataFrame, terms: list[str], most: int = 10_000) -> DataFrame:
    """USES edges from chunks to the terms of a glossary that their text contains, whatever the letter case, each once (RET5). The glossary
    is a short list of at most ``most`` terms, which every task gets; no shuffle but for the repeats."""
    wanted = sorted({t for t in terms if t})
    if len(wanted) > most:
        raise ValueError(f"{len(wanted)} terms, at most {most}")
    listed = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(t.lower()).alias("plain")) for t in wanted]) if wanted else F.array().cast("array<struct<term:string,plain:string>>")
    text = F.lower("chunk_text")
    found = chunks.where("chunk_id IS NOT NULL").select("chunk_id", F.explode(F.filter(listed, lambda t: F.contains(text, t["plain"]))).alias("t"))
    return found.select(F.col("chunk_id").alias("source_id"), F.concat(F.lit("GLOSSARY::"), "t.term").alias("target_id"), F.lit("USES").alias("type")).distinct()
