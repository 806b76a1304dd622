"""Registered queries on extraction, the graph and retrieval, with their SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.chunk_sql import ONE_JUDGMENT, judgment_ctes, literal, statute_ctes, strip
from tessera.functions.text import WHITE_SPACE
from tessera.operators import graph, retrieve
from tessera.operators.chunking import judgment_chunks, sentences_of, statute_chunks
from tessera.operators.extract import LAW_NAME, PATTERNS, SIGNALS, applied_articles, extract_with_model, failures, flat_results, has_signal, law_links, resolved_relations, rule_entities, to_extract
from tessera.session import cut_lineage, spread
from tessera.sources.tables import latest_per_key, read_table


def chunk_entities(spark, folder):
    return rule_entities(read_table(spark, folder, "chunk").select("chunk_id", "chunk_text").distinct())


def statute_links(spark, folder):
    return law_links(read_table(spark, folder, "phapdien_unified").select("doc_id", "source_links_json")).groupBy("doc_id", "item_id", "name").agg(F.count("*").alias("n"))


def judgment_articles(spark, folder):
    return applied_articles(read_table(spark, folder, "anle_unified")).distinct()


def _chunks(spark, folder):
    return read_table(spark, folder, "chunk").select("chunk_id", "chunk_text", "embed_text").distinct()


def chunks_to_extract(spark, folder):
    return to_extract(_chunks(spark, folder), read_table(spark, folder, "extracted_relation"))


#: What the rule model may say: its budget and the cost of a name.
BUDGET, NAME_COST = 8, 4


def rule_model(context: str, content: str, budget: int) -> tuple[str, bool]:
    """A model that needs no server: it answers with the article numbers of the text, each relating to the first; an answer whose names
    cost more than the budget is cut off."""
    names = list(dict.fromkeys(re.findall(r"[Đđ]iều [0-9]+", content)))
    entities = [{"name": n, "type": "DIEU"} for n in names]
    answer = json.dumps({"entities": entities, "relations": [{"source": n, "target": names[0], "type": "LIEN_QUAN"} for n in names[1:]]})
    return answer, len(names) * NAME_COST <= budget


def _asked(spark, folder):
    """What the rule model says of every chunk that has no relation yet."""
    return extract_with_model(chunks_to_extract(spark, folder), rule_model, budget=BUDGET)


def model_extraction(spark, folder):
    names = F.array_join(F.transform("result.entities", lambda e: e["name"]), "|")
    return _asked(spark, folder).select("chunk_id", "part", names.alias("names"), F.when(F.col("result").isNotNull(), F.size("result.relations")).alias("n_relations"), "error", "attempts")


def model_failures(spark, folder):
    """How many answers failed, and why."""
    return failures(_asked(spark, folder))


def graph_with_model(spark, folder):
    """The edges that the rule model's answers add to the graph, and how often each comes."""
    entities, relations = flat_results(_asked(spark, folder).where("error IS NULL"))
    edges = graph.model_results(entities, relations)[1]
    return edges.groupBy("source_id", "target_id", "type", "properties").agg(F.count("*").alias("n"))


def relation_ids(spark, folder):
    return resolved_relations(read_table(spark, folder, "extracted_relation"), read_table(spark, folder, "extracted_entity"))


def _tables(spark, folder):
    return read_table(spark, folder, "nodes"), read_table(spark, folder, "edges")


def nodes_by_label(spark, folder):
    return graph.counts_by(_tables(spark, folder)[0], "label")


def edges_by_type(spark, folder):
    return graph.counts_by(_tables(spark, folder)[1], "type")


def merged_nodes(spark, folder):
    return graph.merged_nodes(_tables(spark, folder)[0], "loaded_at")


def merged_edges(spark, folder):
    nodes, edges = _tables(spark, folder)
    return graph.merged_edges(edges, nodes, ["loaded_at", "edge_id"])


def repeated_nodes(spark, folder):
    return graph.repeated_ids(_tables(spark, folder)[0])


def applied_hops(spark, folder):
    nodes, edges = _tables(spark, folder)
    return graph.one_hop(nodes, edges, "AN_LE", "APPLIES_ARTICLE")


def chunk_laws(spark, folder):
    return graph.two_hops(_tables(spark, folder)[1], "BELONGS_TO", "THUOC")


def _built(spark, folder):
    scraped = read_table(spark, folder, "phapdien_unified")
    statutes = latest_per_key(scraped.withColumn("ord", F.struct("scraped_at", "metadata_json", "source_note_text")), "doc_id", "ord").drop("ord")
    judgments = read_table(spark, folder, "anle_unified").where("doc_id IS NOT NULL").distinct()
    return graph.build_graph(
        cut_lineage(statute_chunks(spread(statutes))), cut_lineage(judgment_chunks(judgments, sentences_of(judgments))), statutes, judgments, read_table(spark, folder, "extracted_entity"), read_table(spark, folder, "extracted_relation")
    )


def built_nodes(spark, folder):
    return _built(spark, folder)[0]


def built_edges(spark, folder):
    return _built(spark, folder)[1].groupBy("source_id", "target_id", "type", "properties").agg(F.count("*").alias("n"))


def hierarchy_edges(spark, folder):
    return graph.hierarchy_edges(read_table(spark, folder, "phapdien_unified"))


def glossary_edges(spark, folder):
    """Chunks that use one of the corpus's subjects' words for papers."""
    return graph.glossary_edges(read_table(spark, folder, "chunk"), GLOSSARY)


def similar_vectors(spark, folder):
    vectors = read_table(spark, folder, "embeddings").select("vec_id", "embedding")
    return retrieve.top_similar(vectors.where("vec_id % 100 = 0"), vectors, 5).select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "rank")


QUESTION = "giấy xác nhận cư trú của chủ tàu cá trước phiên hòa giải"


GLOSSARY = ["Bản kê tài sản", "Biên bản đo đạc", "giấy phép", "hợp đồng đặt cọc", "phiên hòa giải", "Thời hiệu"]


def full_text_top(spark, folder):
    return retrieve.full_text(read_table(spark, folder, "chunk"), QUESTION, 10, "chunk_id", "chunk_text")


def entity_names_top(spark, folder):
    """Entities whose names hold the words of a question."""
    entities = read_table(spark, folder, "nodes").where("label = 'ENTITY'").select("id", F.get_json_object("properties", "$.name").alias("name"))
    return retrieve.full_text(entities, "tòa án nhân dân huyện", 10, "id", "name")


def hybrid_top(spark, folder):
    """Words, vectors and neighbours in the graph, fused."""
    chunks = read_table(spark, folder, "chunk").select("chunk_id", "chunk_text").dropDuplicates(["chunk_id"])
    words = retrieve.full_text(chunks, QUESTION, 20, "chunk_id", "chunk_text")
    asked = retrieve.hashed_embeddings(spark.range(1).select(F.lit("?").alias("chunk_id"), F.lit(QUESTION).alias("chunk_text")), "chunk_id", "chunk_text")
    near = retrieve.top_similar(asked, retrieve.hashed_embeddings(chunks, "chunk_id", "chunk_text"), 20, "key").select(F.col("id").alias("key"), "rank")
    edges = _tables(spark, folder)[1].where("type = 'MENTIONS' AND target_id != ''").select("source_id", "target_id").distinct()
    seeds = edges.join(words.select(F.col("key").alias("source_id")), "source_id").select("target_id").distinct()
    linked = edges.join(seeds, "target_id").groupBy(F.col("source_id").alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(20)
    linked = linked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "key")))
    return retrieve.fused([words, near, linked], 10)


def chunk_embeddings(spark, folder):
    """The places of every chunk's vector that are not 0."""
    chunks = read_table(spark, folder, "chunk").select("chunk_id", "chunk_text").distinct()
    vectors = retrieve.hashed_embeddings(chunks, "chunk_id", "chunk_text").select("key", F.posexplode("embedding").alias("place", "weight")).where("weight != 0")
    return vectors.select("key", "place", F.round(F.col("weight").cast("double"), 5).alias("weight"))


def signal_share(spark, folder):
    """How many chunks of each type the prefilter lets through."""
    chunks = read_table(spark, folder, "chunk")
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("n"), F.count_if(has_signal(F.col("chunk_text"))).alias("n_signal"))


QUERIES = {
    "chunk_entities": chunk_entities,
    "statute_links": statute_links,
    "judgment_articles": judgment_articles,
    "signal_share": signal_share,
    "chunks_to_extract": chunks_to_extract,
    "model_extraction": model_extraction,
    "model_failures": model_failures,
    "graph_with_model": graph_with_model,
    "relation_ids": relation_ids,
    "nodes_by_label": nodes_by_label,
    "edges_by_type": edges_by_type,
    "merged_nodes": merged_nodes,
    "merged_edges": merged_edges,
    "repeated_nodes": repeated_nodes,
    "applied_hops": applied_hops,
    "chunk_laws": chunk_laws,
    "built_nodes": built_nodes,
    "built_edges": built_edges,
    "hierarchy_edges": hierarchy_edges,
    "glossary_edges": glossary_edges,
    "similar_vectors": similar_vectors,
    "full_text_top": full_text_top,
    "entity_names_top": entity_names_top,
    "hybrid_top": hybrid_top,
    "chunk_embeddings": chunk_embeddings,
}

# The expressions as the SQL engine writes them: its classes know Unicode only by name, and letter case is an option of the call.
_SIGNAL = SIGNALS.removeprefix("(?iU)")
_WORD = "[\\p{L}\\p{M}\\p{N}_"
_BLANK = "\\s\\x{B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


_CLASSES = {
    "[\\s\\w]": _WORD + _BLANK + "]",
    "[\\w.\\-]": _WORD + ".\\-]",
    "[\\w.\\-/]": _WORD + ".\\-/]",
    "[\\w/.\\-]": _WORD + "/.\\-]",
    "\\s": f"[{_BLANK}]",
    "\\d": "\\p{Nd}",
}


def _for_sql(pattern: str) -> str:
    """An expression of the extraction rules with its classes of blanks, digits and word characters spelt out."""
    return re.sub("|".join(map(re.escape, _CLASSES)), lambda m: _CLASSES[m[0]], pattern.removeprefix("(?iU)"))


_FOUND = {kind: _for_sql(pattern) for kind, pattern in PATTERNS.items()}
_NAME = _for_sql(LAW_NAME)


def _rules(chunks: str, found: str) -> str:
    """``found`` (chunk_id, type, name, id): what the rules find in a table of chunks, each once a chunk."""
    each = " UNION ALL ".join(f"SELECT chunk_id, '{k}' AS type, rtrim(trim(unnest(regexp_extract_all(chunk_text, '{p}', 0, 'i')), {literal(WHITE_SPACE)}), ' .,;:\"') AS name FROM {chunks}" for k, p in _FOUND.items())
    return f"{found} AS (SELECT DISTINCT chunk_id, type, name, 'ENT::' || type || '::' || lower({strip('name')}) AS id FROM ({each}) WHERE name <> '')"


_LINKS = f"""links AS (
      SELECT doc_id, unnest(from_json(source_links_json, '[{{"text":"VARCHAR","href":"VARCHAR"}}]')) AS l
      FROM %s WHERE doc_id <> '' AND json_valid(source_links_json) AND json_type(source_links_json) = 'ARRAY'
    ), named_links AS (
      SELECT doc_id, regexp_extract(l.href, 'ItemID=([0-9]+)', 1) AS item_id, regexp_extract(l.text, '{_NAME}', 1, 'i') AS kind, regexp_extract(l.text, '{_NAME}', 2, 'i') AS number, l.href AS url FROM links
    )"""
_RELATED = f"""named_entities AS (
      SELECT chunk_id, lower(trim(name, ' ')) AS k, arg_max('ENT::' || type || '::' || lower({strip('name')}), mention_id) AS entity_id
      FROM %s WHERE name IS NOT NULL AND type IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL
    ), ends AS (SELECT DISTINCT relation_id, chunk_id, type, lower(trim(source, ' ')) AS s, lower(trim(target, ' ')) AS t FROM %s WHERE type <> ''
    ), related AS (
      SELECT r.relation_id, r.chunk_id, a.entity_id AS source_id, b.entity_id AS target_id, r.type
      FROM ends r JOIN named_entities a ON a.chunk_id = r.chunk_id AND a.k = r.s JOIN named_entities b ON b.chunk_id = r.chunk_id AND b.k = r.t
    )"""
_CONTEXT = "CASE WHEN coalesce(chunk_text, '') <> '' AND ends_with(coalesce(embed_text, ''), chunk_text) THEN left(embed_text, length(embed_text) - length(chunk_text)) ELSE coalesce(embed_text, '') END"
_TODO = f"""todo AS (
      SELECT chunk_id, CAST(start / 4000 AS INTEGER) AS part, CASE WHEN {strip('context')} = '' THEN '(không có)' ELSE {strip('context')} END AS context, substr(chunk_text, start + 1, 4000) AS content
      FROM (SELECT DISTINCT chunk_id, chunk_text, {_CONTEXT} AS context, unnest(generate_series(0, greatest(length(chunk_text) - 1, 0), 4000)) AS start FROM chunk
        WHERE regexp_matches(chunk_text, '{_SIGNAL}', 'i') AND chunk_id NOT IN (SELECT chunk_id FROM extracted_relation WHERE chunk_id IS NOT NULL))
    ), said AS (
      SELECT chunk_id, part, list_filter(names, lambda x, i: list_position(names, x) = i) AS names FROM (SELECT chunk_id, part, regexp_extract_all(content, '[Đđ]iều [0-9]+') AS names FROM todo)
    ), answers AS (
      SELECT *, len(names) * {NAME_COST} <= {2 * BUDGET} AS ended, CASE WHEN len(names) * {NAME_COST} <= {BUDGET} THEN 1 ELSE 2 END AS attempts FROM said
    )"""
_json = lambda **fields: "to_json({" + ", ".join(f"'{n}': {c}" for n, c in fields.items()) + "})::VARCHAR"
_LAST_STATUTE = "last_statute AS (SELECT * FROM phapdien_unified WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY scraped_at DESC) = 1)"
_GRAPH = f"""WITH RECURSIVE {_LAST_STATUTE}, {statute_ctes('last_statute')}, {ONE_JUDGMENT}, {judgment_ctes('one_judgment')},
    {_rules('made_statutes', 'found_statutes')}, {_rules('made_judgments', 'found_judgments')}, {_LINKS % 'last_statute'}, {_RELATED % ('extracted_entity', 'extracted_relation')},
    applied AS (SELECT j.doc_id, c.chunk_id, 'ENT::DIEU::điều ' || j.applied_article_number AS id, 'Điều ' || j.applied_article_number AS name
      FROM one_judgment j JOIN made_judgments c ON c.doc_id = j.doc_id WHERE j.applied_article_number <> 0),
    mentions AS (SELECT DISTINCT mention_id, chunk_id, name, type, 'ENT::' || type || '::' || lower({strip('name')}) AS id FROM extracted_entity WHERE chunk_id IS NOT NULL AND name <> '' AND type <> '')"""


def _candidates(stage: int, chunks: str, found: str, label: str, source: str, parent: str) -> str:
    order = "doc_id || '/' || lpad(CAST(chunk_index AS VARCHAR), 9, '0')"
    own = _json(text="chunk_text", embed_text="embed_text", chunk_type="chunk_type", source=f"'{source}'")
    return f"""SELECT {stage} AS stage, {order} AS ord, chunk_id AS id, 'CHUNK' AS label, {own} AS properties FROM {chunks}
    UNION ALL SELECT {stage}, {order}, doc_id, '{label}', {parent} FROM {chunks}
    UNION ALL SELECT {stage}, chunk_id, id, 'ENTITY', {_json(name='name', entity_type='type', source="'regex'")} FROM {found}"""


_NODES = " UNION ALL ".join(
    [
        _candidates(0, "made_statutes", "found_statutes", "ARTICLE", "phapdien", _json(article_id="article_id", title="article_title", chapter="chapter_title", topic="topic_title_vi", subject="subject_title_vi")),
        _candidates(1, "made_judgments", "found_judgments", "AN_LE", "anle", _json(title="title", case_type="case_type", year="year")),
        f"SELECT 1, doc_id, id, 'ENTITY', {_json(name='name', entity_type=repr('DIEU'), source=repr('metadata'))} FROM applied",
        f"SELECT 2, doc_id, 'VBPL::' || item_id, 'ENTITY', {_json(name=repr('') + ' || kind || ' + repr(' số ') + ' || number', entity_type=repr('VBPL'), source=repr('source_links'), url='url')} FROM named_links WHERE item_id <> '' AND kind <> ''",
        f"SELECT 3, chunk_id || '/' || mention_id, id, 'ENTITY', {_json(name='name', entity_type='type', source=repr('llm'))} FROM mentions",
    ]
)
_EDGES = " UNION ALL ".join(
    [f"SELECT chunk_id AS source_id, doc_id AS target_id, 'BELONGS_TO' AS type, '{{}}' AS properties FROM {c}" for c in ("made_statutes", "made_judgments")]
    + [f"SELECT chunk_id, id, 'MENTIONS', '{{}}' FROM {c}" for c in ("found_statutes", "found_judgments", "mentions")]
    + [
        "SELECT doc_id, id, 'APPLIES_ARTICLE', '{}' FROM applied",
        "SELECT doc_id, 'VBPL::' || item_id, 'THUOC', '{\"via\":\"source_links\"}' FROM named_links WHERE item_id <> '' AND kind <> ''",
        f"SELECT source_id, target_id, type, {_json(source=repr('llm'), from_chunk='chunk_id')} FROM related",
    ]
)


def _merged_sql(table: str, keys: str, order: str, where: str) -> str:
    """Merged properties: of every name the value of the last row that has it."""
    return f"""WITH r AS (SELECT *, CASE WHEN starts_with(properties, '{{') AND json_valid(properties) THEN properties END AS object FROM {table} WHERE {where}),
      e AS (SELECT {keys}, k, arg_max(CAST(json_extract(object, '$."' || k || '"') AS VARCHAR), ({order}, properties)) AS v FROM (SELECT *, unnest(json_keys(object)) AS k FROM r) GROUP BY ALL),
      o AS (SELECT {keys}, '{{' || string_agg('"' || k || '":' || v, ',' ORDER BY k) || '}}' AS merged FROM e GROUP BY ALL)
      SELECT {keys}, coalesce(any_value(merged), '{{}}') AS properties, count(*) AS n_rows FROM r LEFT JOIN o USING ({keys}) GROUP BY {keys}"""


def _full_text_sql(source: str, key: str, text: str, question: str, k: int) -> str:
    return f"""d AS (
          SELECT {key} AS key, list_filter(regexp_split_to_array(lower(max(coalesce({text}, ''))), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> '') AS terms FROM {source} WHERE {key} IS NOT NULL GROUP BY 1
        ), w AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM d),
        q AS (SELECT DISTINCT unnest(string_split('{question}', ' ')) AS term),
        tf AS (SELECT key, term, count(*) AS tf, max(length) AS length FROM (SELECT key, len(terms) AS length, unnest(terms) AS term FROM d) JOIN q USING (term) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        s AS (SELECT key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM tf JOIN df USING (term), w GROUP BY 1),
        by_words AS (SELECT key, score, CAST(row_number() OVER (ORDER BY score DESC, key) AS INTEGER) AS rank FROM s ORDER BY score DESC, key LIMIT {k})"""


_TEXTS = f"texts AS (SELECT DISTINCT chunk_id AS key, chunk_text AS text FROM chunk UNION ALL SELECT '?', '{QUESTION}')"
_VECTORS = f"""{_TEXTS}, codes AS (
      SELECT key, CAST('0x' || substr(md5(w), 1, 3) AS INTEGER) AS c FROM (SELECT key, unnest(regexp_split_to_array(lower(text), '[\\s\\x{{B}}]+')) AS w FROM texts) WHERE w <> ''
    ), sums AS (SELECT key, c % 64 AS place, sum(CASE WHEN c >= 2048 THEN 1 ELSE -1 END) AS x FROM codes GROUP BY ALL
    ), vectors AS (SELECT key, place, x / sqrt(sum(x * x) OVER (PARTITION BY key)) AS weight FROM sums QUALIFY sum(x * x) OVER (PARTITION BY key) > 0)"""

SQL = {
    "chunk_entities": f"WITH {_rules('chunk', 'found')} SELECT chunk_id, type, name, id AS entity_id FROM found",
    "statute_links": f"WITH {_LINKS % 'phapdien_unified'} SELECT doc_id, item_id, kind || ' số ' || number AS name, count(*) AS n FROM named_links WHERE item_id <> '' AND kind <> '' GROUP BY ALL",
    "judgment_articles": """SELECT DISTINCT doc_id, 'ENT::DIEU::điều ' || applied_article_number AS entity_id, 'Điều ' || applied_article_number AS name
        FROM anle_unified WHERE applied_article_number IS NOT NULL AND applied_article_number <> 0""",
    "signal_share": f"SELECT chunk_type, count(*) AS n, count(*) FILTER (WHERE regexp_matches(chunk_text, '{_SIGNAL}', 'i')) AS n_signal FROM chunk GROUP BY 1",
    "chunks_to_extract": f"WITH {_TODO} SELECT * FROM todo",
    "model_extraction": f"""WITH {_TODO} SELECT chunk_id, part, CASE WHEN ended THEN array_to_string(names, '|') END AS names, CASE WHEN ended THEN CAST(greatest(len(names) - 1, 0) AS INTEGER) END AS n_relations,
        CASE WHEN NOT ended THEN 'cut off' END AS error, attempts FROM answers""",
    "model_failures": f"WITH {_TODO} SELECT CASE WHEN NOT ended THEN 'cut off' END AS error, count(*) AS n FROM answers GROUP BY 1",
    "graph_with_model": f"""WITH {_TODO} SELECT source_id, target_id, type, properties, count(*) AS n FROM (
          SELECT chunk_id AS source_id, 'ENT::DIEU::' || lower(unnest(names)) AS target_id, 'MENTIONS' AS type, '{{}}' AS properties FROM answers WHERE ended
          UNION ALL SELECT 'ENT::DIEU::' || lower(unnest(names[2:])), 'ENT::DIEU::' || lower(names[1]), 'LIEN_QUAN', {_json(source=repr('llm'), from_chunk='chunk_id')} FROM answers WHERE ended
        ) GROUP BY ALL""",
    "relation_ids": f"WITH {_RELATED % ('extracted_entity', 'extracted_relation')} SELECT * FROM related",
    "nodes_by_label": "SELECT label, count(*) AS n FROM nodes GROUP BY 1 ORDER BY n DESC, label NULLS FIRST",
    "edges_by_type": "SELECT type, count(*) AS n FROM edges GROUP BY 1 ORDER BY n DESC, type NULLS FIRST",
    "merged_nodes": f"SELECT * EXCLUDE (n_rows) FROM ({_merged_sql('nodes', 'id, label', 'loaded_at', 'id IS NOT NULL AND label IS NOT NULL')})",
    "merged_edges": _merged_sql("edges", "source_id, target_id, type", "loaded_at, edge_id", "type IS NOT NULL AND source_id IN (SELECT id FROM nodes WHERE id IS NOT NULL) AND target_id IN (SELECT id FROM nodes WHERE id IS NOT NULL)"),
    "repeated_nodes": "SELECT label, id, count(*) AS n FROM nodes GROUP BY ALL HAVING count(*) > 1",
    "applied_hops": """SELECT source_id, target_id, count(*) AS n FROM edges WHERE type = 'APPLIES_ARTICLE' AND source_id IN (SELECT id FROM nodes WHERE label = 'AN_LE')
        AND target_id IN (SELECT id FROM nodes WHERE id IS NOT NULL) GROUP BY ALL""",
    "chunk_laws": """SELECT DISTINCT a.source_id AS start_id, b.target_id AS end_id FROM edges a JOIN edges b ON a.target_id = b.source_id
        WHERE a.type = 'BELONGS_TO' AND b.type = 'THUOC' AND a.target_id <> '' AND b.target_id <> ''""",
    "built_nodes": f"{_GRAPH} SELECT id, n.label AS label, n.properties AS properties FROM (SELECT id, min({{'stage': stage, 'ord': ord, 'label': label, 'properties': properties}}) AS n FROM ({_NODES}) WHERE id IS NOT NULL GROUP BY 1)",
    "built_edges": f"{_GRAPH} SELECT source_id, target_id, type, properties, count(*) AS n FROM ({_EDGES}) GROUP BY ALL",
    "hierarchy_edges": """SELECT DISTINCT 'TOPIC::' || topic_id AS source_id, 'SUBJECT::' || subject_id AS target_id, 'HAS_SUBJECT' AS type FROM phapdien_unified WHERE topic_id <> '' AND subject_id <> ''
        UNION ALL SELECT DISTINCT 'SUBJECT::' || subject_id, doc_id, 'HAS_ARTICLE' FROM phapdien_unified WHERE subject_id <> '' AND doc_id <> ''""",
    "glossary_edges": "SELECT DISTINCT chunk_id AS source_id, 'GLOSSARY::' || term AS target_id, 'USES' AS type FROM chunk, (SELECT unnest([" + ", ".join(f"'{t}'" for t in GLOSSARY) + "]) AS term) WHERE chunk_id IS NOT NULL AND contains(lower(chunk_text), lower(term))",
    "similar_vectors": """WITH s AS (
          SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS similarity
          FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM s)
        SELECT query_id, vec_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
    "full_text_top": f"WITH {_full_text_sql('chunk', 'chunk_id', 'chunk_text', QUESTION, 10)} SELECT * FROM by_words",
    "entity_names_top": f"WITH names AS (SELECT id, CASE WHEN json_valid(properties) THEN properties ->> '$.name' END AS name FROM nodes WHERE label = 'ENTITY'), {_full_text_sql('names', 'id', 'name', 'tòa án nhân dân huyện', 10)} SELECT * FROM by_words",
    "hybrid_top": f"""WITH {_full_text_sql('chunk', 'chunk_id', 'chunk_text', QUESTION, 20)}, {_VECTORS},
        cosines AS (SELECT v.key, sum(v.weight * a.weight) AS c FROM vectors v JOIN vectors a ON a.place = v.place WHERE a.key = '?' AND v.key <> '?' GROUP BY 1),
        by_vector AS (SELECT key, row_number() OVER (ORDER BY round(c, 6) DESC, key) AS rank FROM (SELECT DISTINCT v.key, coalesce(c, 0) AS c FROM vectors v LEFT JOIN cosines USING (key) WHERE v.key <> '?') QUALIFY rank <= 20),
        mentioned AS (SELECT DISTINCT source_id, target_id FROM edges WHERE type = 'MENTIONS' AND target_id <> ''),
        by_graph AS (SELECT source_id AS key, row_number() OVER (ORDER BY count(*) DESC, source_id) AS rank FROM mentioned
          WHERE target_id IN (SELECT target_id FROM mentioned WHERE source_id IN (SELECT key FROM by_words)) GROUP BY 1 QUALIFY rank <= 20)
        SELECT key, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT key, rank FROM by_words UNION ALL SELECT key, rank FROM by_vector UNION ALL SELECT key, rank FROM by_graph) GROUP BY 1 ORDER BY score DESC, key LIMIT 10""",
    "chunk_embeddings": f"WITH {_VECTORS} SELECT key, CAST(place AS INTEGER) AS place, round(CAST(CAST(weight AS FLOAT) AS DOUBLE), 5) AS weight FROM vectors WHERE key <> '?' AND weight <> 0",
}
