import json

from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators.extract import (
    ENTITY_TYPES,
    applied_articles,
    configured_endpoint,
    entities_in,
    extract_with_model,
    failures,
    flat_results,
    has_signal,
    law_links,
    overlaid,
    prompted,
    resolved_relations,
    result_schema,
    served_model,
    to_extract,
)


def test_rules(spark):
    text = "Theo NGHỊ ĐỊNH 43/2014/NĐ-CP. và Luật số 32/2004/QH11; khoản 2 Điều 8, điều 9a thì phạt tù từ 3 năm đến 7 năm, tùy theo tháng"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    got = [[(e.type, e.name) for e in r[0]] for r in df.select(entities_in(F.col("t"))).collect()]
    assert got[0] == [("VBPL", "NGHỊ ĐỊNH 43/2014/NĐ-CP"), ("VBPL", "Luật số 32/2004/QH11"), ("DIEU", "khoản 2 Điều 8"), ("DIEU", "điều 9a"), ("KHUNG_HINH_PHAT", "phạt tù từ 3 năm đến 7 năm"), ("KHUNG_HINH_PHAT", "tùy theo tháng")]
    assert got[1] == [] and got[2] == []


def test_links(spark):
    good = json.dumps([{"text": "(Điều 1 Luật số 32/2004/QH11 …)", "href": "http://vbpl.vn/x?ItemID=18562#A"}, {"text": "không", "href": "x?ItemID=1"}, {"text": "Luật 1/2", "href": "y"}])
    df = spark.createDataFrame([("d", good), ("d", "[]"), ("d", "{}"), ("d", "nan"), ("d", "[{"), ("d", None), ("", good), (None, good)], "doc_id string, source_links_json string")
    assert [tuple(r) for r in law_links(df).collect()] == [("d", "18562", "Luật số 32/2004/QH11", "http://vbpl.vn/x?ItemID=18562#A")]


def test_applied_articles(spark):
    df = spark.createDataFrame([("a", 468), ("b", 0), ("c", None)], "doc_id string, applied_article_number long")
    assert [tuple(r) for r in applied_articles(df).collect()] == [("a", "ENT::DIEU::điều 468", "Điều 468")]


def test_relations(spark):
    entities = spark.createDataFrame([("c", "Luật A", "VBPL", "m1"), ("c", "luật a ", "DIEU", "m2"), ("c", "Tòa", "CO_QUAN", "m3"), ("x", "B", "VBPL", "m4"), ("c", None, "VBPL", "m5")], "chunk_id string, name string, type string, mention_id string")
    relations = spark.createDataFrame([(1, "c", "LUẬT A", " tòa ", "THUOC"), (1, "c", "LUẬT A", " tòa ", "THUOC"), (2, "c", "Luật A", "B", "THUOC"), (3, "c", None, "Tòa", "THUOC"), (4, "c", "Tòa", "Luật A", None)], "relation_id long, chunk_id string, source string, target string, type string")
    assert [tuple(r) for r in resolved_relations(relations, entities).collect()] == [(1, "c", "ENT::DIEU::luật a", "ENT::CO_QUAN::tòa", "THUOC")]


def chunks(spark):
    return spark.createDataFrame([("a", "P\ncăn cứ Điều 1", "căn cứ Điều 1"), ("b", "không gì", "không gì"), ("c", "SỬA ĐỔI Điều 2", "SỬA ĐỔI Điều 2"), ("d", None, None)], "chunk_id string, embed_text string, chunk_text string")


def test_prefilter(spark):
    done = spark.createDataFrame([("c",)], "chunk_id string")
    assert [tuple(r) for r in to_extract(chunks(spark), done).collect()] == [("a", 0, "P", "căn cứ Điều 1")]
    assert chunks(spark).where(has_signal(F.col("chunk_text"))).count() == 2


def test_long_content_comes_in_parts(spark):
    rows = to_extract(chunks(spark), chunks(spark).limit(0), most=6, sample_size=1).orderBy("part").collect()
    assert [(r.chunk_id, r.part, r.content) for r in rows] == [("a", 0, "căn cứ"), ("a", 1, " Điều "), ("a", 2, "1")]
    assert {r.chunk_id for r in to_extract(chunks(spark), chunks(spark).limit(0), sample_size=2).collect()} == {"a"}


def test_a_served_model_gets_the_filled_prompt(spark):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            answer = json.dumps({"choices": [{"message": {"content": '{"entities": [], "relations": []}'}, "finish_reason": "stop"}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    spark.conf.set("tessera.model.url", f"http://127.0.0.1:{server.server_port}/v1")
    try:
        model = prompted(served_model(configured_endpoint(spark)), "Context: {context}\nText: {content}")
        assert model("c", "t", 7) == ('{"entities": [], "relations": []}', True)
    finally:
        spark.conf.unset("tessera.model.url")
        server.shutdown()
    assert asked[0]["messages"][0]["content"] == "Context: c\nText: t" and asked[0]["max_tokens"] == 7 and asked[0]["temperature"] == 0
    assert result_schema()["properties"]["entities"]["items"]["properties"]["type"]["enum"] == list(ENTITY_TYPES)


def test_later_results_lie_over_earlier_ones(spark):
    schema = "chunk_id string, part int, result struct<entities:array<struct<name:string,type:string>>,relations:array<struct<source:string,target:string,type:string>>>, error string"
    earlier = spark.createDataFrame([("a", 0, ([("x", "DIEU")], []), None), ("a", 1, ([("y", "DIEU")], []), None), ("b", 0, ([], []), None)], schema)
    later = spark.createDataFrame([("a", 0, ([("z", "DIEU")], []), None), ("c", 0, None, "TypeError: 1"), ("d", 0, None, "TypeError: 2")], schema)
    kept = overlaid(earlier, later.where("error IS NULL"))
    assert sorted((r.chunk_id, r.part, [e.name for e in r.result.entities]) for r in kept.collect()) == [("a", 0, ["z"]), ("b", 0, [])]
    assert sorted(map(tuple, failures(later).collect()), key=str) == [("TypeError", 2), (None, 1)]


def test_model_is_asked_again_once(spark):
    def model(context, content, budget):
        if "Điều 2" in content:
            raise RuntimeError("down")
        if budget == 10:
            return '{"entities": [', False
        return json.dumps({"entities": [{"name": "Điều 1", "type": "DIEU"}, {"name": "x", "type": "NO"}], "relations": [{"source": "a", "target": "b", "type": "NO"}]}), True

    rows = {r.chunk_id: r for r in extract_with_model(to_extract(chunks(spark), chunks(spark).limit(0)), model, 2, 10).collect()}
    assert rows["a"].attempts == 2 and [e.name for e in rows["a"].result.entities] == ["Điều 1"] and rows["a"].result.relations == []
    assert rows["c"].result is None and "down" in rows["c"].error


NODES = "id string, label string, properties string, loaded_at long"
EDGES = "edge_id long, source_id string, target_id string, type string, properties string, loaded_at long"


def test_merging(spark):
    nodes = spark.createDataFrame([("a", "X", '{"p": 1, "q": "old"}', 1), ("a", "X", '{"q": "new \\"x\\"", "r": null}', 2), ("a", "X", "broken", 3), ("b", "X", None, 1), (None, "X", "{}", 1)], NODES)
    edges = spark.createDataFrame([(1, "a", "b", "t", '{"o": [1, 2]}', 1), (2, "a", "b", "t", None, 2), (3, "a", "z", "t", "{}", 1), (4, "a", None, "t", "{}", 1)], EDGES)
    assert sorted(map(tuple, graph.merged_nodes(nodes, "loaded_at").collect())) == [("a", "X", '{"p":1,"q":"new \\"x\\"","r":null}'), ("b", "X", "{}")]
    assert [tuple(r) for r in graph.merged_edges(edges, nodes, ["loaded_at", "edge_id"]).collect()] == [("a", "b", "t", '{"o":[1,2]}', 2)]
    assert graph.merged_nodes(nodes.limit(0), "loaded_at").count() == 0
    assert [tuple(r) for r in graph.repeated_ids(nodes.where("id IS NOT NULL")).collect()] == [("X", "a", 3)]
    assert [tuple(r) for r in graph.counts_by(nodes, "id").collect()] == [("a", 3), (None, 1), ("b", 1)]


def test_hierarchy_and_glossary(spark):
    statutes = spark.createDataFrame([("d1", "t", "s"), ("d1", "t", "s"), ("d2", None, "s"), ("", "t", ""), (None, "", "u")], "doc_id string, topic_id string, subject_id string")
    edges = sorted(map(tuple, graph.hierarchy_edges(statutes).collect()))
    assert edges == [("SUBJECT::s", "d1", "HAS_ARTICLE"), ("SUBJECT::s", "d2", "HAS_ARTICLE"), ("TOPIC::t", "SUBJECT::s", "HAS_SUBJECT")]
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("b", "a"), ("c", "")], "id string, parent_id string")
    assert [tuple(r) for r in graph.tree_edges(tree).collect()] == [("a", "b", "HAS_CHILD")]
    uses = graph.glossary_edges(chunks(spark), ["CĂN CỨ", "", "Điều", "CĂN CỨ"])
    assert sorted((r.source_id, r.target_id) for r in uses.collect()) == [("a", "GLOSSARY::CĂN CỨ"), ("a", "GLOSSARY::Điều"), ("c", "GLOSSARY::Điều")]
    assert graph.glossary_edges(chunks(spark), []).count() == 0


def test_first_writer_wins(spark):
    rows = [("a", "L", "late", 1, "0"), ("a", "L", "second", 0, "2"), ("a", "L", "first", 0, "1"), (None, "L", "x", 0, "1")]
    df = spark.createDataFrame(rows, "id string, label string, properties string, stage int, ord string")
    assert [tuple(r) for r in graph.first_writer_wins(df).collect()] == [("a", "L", "first")]


def test_walks(spark):
    edges = spark.createDataFrame([(1, "c", "d", "B", "", 1), (2, "d", "l", "T", "", 1), (3, "d", "l", "T", "", 1), (4, "d", "", "T", "", 1)], EDGES)
    assert [tuple(r) for r in graph.two_hops(edges, "B", "T").collect()] == [("c", "l")]
    nodes = spark.createDataFrame([("d", "A", "", 1), ("l", "E", "", 1)], NODES)
    assert [tuple(r) for r in graph.one_hop(nodes, edges, "A", "T").collect()] == [("d", "l", 2)]


def test_model_results_reach_the_graph(spark):
    results = [("c", json.dumps({"entities": [{"name": "Luật A", "type": "VBPL"}, {"name": "Tòa", "type": "CO_QUAN"}, {"name": " tòa", "type": "CO_QUAN"}, {"name": "", "type": "DIEU"}], "relations": [{"source": "LUẬT A", "target": "tòa ", "type": "SUA_DOI"}, {"source": "LUẬT A", "target": "tòa ", "type": "SUA_DOI"}, {"source": "Luật A", "target": "không có", "type": "THAY_THE"}]}))] * 2
    asked = spark.createDataFrame([("c", 0, "", r) for _, r in results], "chunk_id string, part int, context string, content string")
    entities, relations = flat_results(extract_with_model(asked, lambda context, content, budget: (content, True)))
    assert entities.count() == 4 and relations.count() == 3
    statute = spark.createDataFrame([("c", "d", 0, "Theo Luật 1/2", "Theo Luật 1/2", "khoan", "1", "T", "C", "A", "B")], "chunk_id string, doc_id string, chunk_index int, chunk_text string, embed_text string, chunk_type string, article_id string, article_title string, chapter_title string, topic_title_vi string, subject_title_vi string")
    judgment = spark.createDataFrame([], "chunk_id string, doc_id string, chunk_index int, chunk_text string, embed_text string, chunk_type string, title string, case_type string, year int")
    statutes = spark.createDataFrame([], "doc_id string, source_links_json string")
    judgments = spark.createDataFrame([], "doc_id string, applied_article_number long")
    nodes, edges = graph.build_graph(statute, judgment, statutes, judgments, entities, relations)
    by_model = {r.id: json.loads(r.properties) for r in nodes.collect() if json.loads(r.properties).get("source") == "llm"}
    assert {i: p["name"] for i, p in by_model.items()} == {"ENT::VBPL::luật a": "Luật A", "ENT::CO_QUAN::tòa": "Tòa"}
    found = sorted((r.source_id, r.target_id, r.type, r.properties) for r in edges.where("type != 'BELONGS_TO'").collect())
    origin = '{"source":"llm","from_chunk":"c"}'
    assert found == [("ENT::VBPL::luật a", "ENT::CO_QUAN::tòa", "SUA_DOI", origin)] * 2 + [("c", "ENT::CO_QUAN::tòa", "MENTIONS", "{}")] * 2 + [("c", "ENT::VBPL::luật 1/2", "MENTIONS", "{}"), ("c", "ENT::VBPL::luật a", "MENTIONS", "{}")]
