import importlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import report, retrieve
from tessera.operators.enrich import filled, last_per_key, links_json, unified_judgments, whole_number, with_ontology
from tessera.sources.tables import latest_per_key, read_jsonl, read_or_empty, resolve_input, resolve_inputs, write_table
from tessera.streaming.resume import extract_new


def test_formats_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("0012", 1, 'a,"b"'), ("x", None, "")], "id string, n long, t string")
    paths = write_table(df, str(tmp_path), "t", ("jsonl", "parquet", "csv"), single_file=True)
    assert sorted(map(tuple, read_jsonl(spark, paths["jsonl"], df.schema).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert spark.read.schema(df.schema).option("header", "true").option("escape", '"').csv(paths["csv"]).count() == 2
    assert resolve_input(spark, f"{tmp_path}/t", df.schema).count() == 2
    with pytest.raises(ValueError):
        write_table(df, str(tmp_path), "t", ("xml",))
    with pytest.raises(FileNotFoundError):
        resolve_input(spark, f"{tmp_path}/none", df.schema)
    assert resolve_inputs(spark, {f"{tmp_path}/t": df.schema})[f"{tmp_path}/t"].count() == 2
    with pytest.raises(FileNotFoundError, match="none.*other"):
        resolve_inputs(spark, {f"{tmp_path}/none": df.schema, f"{tmp_path}/t": df.schema, f"{tmp_path}/other": df.schema})
    assert read_or_empty(spark, f"{tmp_path}/none.parquet", df.schema).count() == 0


def test_last_line_wins_and_broken_lines_drop(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "a", "seq": 1, "v": "x"}\nbroken\n{"chunk_id": "a", "seq": 2, "v": "y"}\n{"seq": 3}\n')
    lines = read_jsonl(spark, f"{tmp_path}/c.jsonl", T._parse_datatype_string("chunk_id string, seq long, v string"))
    assert [tuple(r) for r in latest_per_key(lines, "chunk_id", "seq").collect()] == [("a", 2, "y")]


def test_enrichment(spark):
    articles = spark.createDataFrame([("a", "1", "vi", None, None, "s", "own", None), ("b", "9", None, "x", "x", None, None, "x")], "doc_id string, topic_id string, topic_title_vi string, topic_title_en string, topic_note string, subject_id string, subject_title_vi string, subject_title_en string")
    topics = spark.createDataFrame([("1", "old", "en", "n", 1), ("1", "", "new", "n", 2), (None, "z", "z", "z", 3), ("", "z", "z", "z", 4)], "topic_id string, topic_title_vi string, topic_title_en string, topic_note string, ord int")
    subjects = spark.createDataFrame([("s", "S", "E", 1)], "subject_id string, subject_title_vi string, subject_title_en string, ord int")
    rows = {r.doc_id: r for r in with_ontology(articles, topics, subjects).collect()}
    assert (rows["a"].topic_title_vi, rows["a"].topic_title_en, rows["a"].subject_title_vi) == ("vi", "new", "S")
    assert (rows["b"].topic_title_vi, rows["b"].topic_title_en, rows["b"].subject_title_vi) == ("", "", "")
    assert last_per_key(topics, "topic_id", "ord").count() == 1


def test_filling(spark):
    df = spark.createDataFrame([(None, None, None, "3.7"), ("a", 1, 0.5, "x")], "s string, n long, d double, w string")
    assert [tuple(r) for r in filled(df.select("s", "n", "d", whole_number("w").alias("w"))).collect()] == [("", 0, 0.0, 3), ("a", 1, 0.5, 0)]
    links = spark.createDataFrame([([("t", None)],), (None,)], "l array<struct<text:string,href:string>>").select(links_json(F.col("l"))).collect()
    assert links[0][0] == '[{"text":"t","href":""}]' and links[1][0] == "[]"
    raw = spark.createDataFrame([("d", "m", 1, None, "p")], "doc_name string, markdown string, char_len long, text_hash string, parser_model string")
    assert unified_judgments(raw).first().asDict() == {"doc_id": "d", "content_markdown": "m", "content_char_len": 1, "metadata_json": '{"text_hash":null,"parser_model":"p"}'}


def test_reports(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 4), (None, 5), ("b", None)], "k string, v long")
    assert {(r.k, r.n, r.upper_median) for r in report.size_statistics(df, "v", "k").collect()} == {("a", 4, 3), (None, 1, 5)}
    assert report.number_summary(df.where("k = 'a'"), "v").first().median == 2.5
    assert [(r.column_name, r.n_missing) for r in report.missing_values(df, ["k", "v"]).collect()] == [("k", 1), ("v", 1)]
    assert report.positive_range(df.limit(0), "v").first()[0] is None
    assert [r.value for r in report.value_counts(df, ["k"]).collect()] == ["a", None, "b"]
    children = spark.createDataFrame([("p", "1", 2), ("p", "1", 2), ("p", "2", 4), ("q", "3", 9), (None, None, 1)], "parent string, child string, words long")
    assert tuple(report.per_parent(children, "parent", "child", "words").first()) == (3, 3, 1.0, 5.0, 4.0)
    assert tuple(report.failed_share(df, "k").first()) == (6, 5)


def test_vector_search_against_brute_force(spark):
    points = np.random.default_rng(0).normal(size=(300, 8))
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(900, None), (901, [0.0] * 8), (902, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in retrieve.top_similar(df.where("vec_id % 100 = 0"), df, 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    for q in (0, 100, 200):
        scores = unit @ unit[q]
        scores[q] = -2
        assert [got[q][i] for i in range(1, 6)] == list(np.argsort(-scores)[:5])
    assert retrieve.top_similar(df.limit(0), df, 5).count() == 0


def test_full_text(spark):
    df = spark.createDataFrame([("a", "tòa án xã"), ("b", "Tòa tòa"), ("c", None), ("d", ""), ("e", "khác")], "key string, text string")
    assert [r.key for r in retrieve.full_text(df, "tòa", 10, "key", "text").collect()] == ["b", "a"]
    vectors = {r.key: r.embedding for r in retrieve.hashed_embeddings(df, "key", "text").collect()}
    assert vectors["c"] is None and not any(vectors["d"]) and abs(sum(x * x for x in vectors["a"]) - 1) < 1e-6
    assert vectors["b"] == [x for x in vectors["b"]] and sum(x != 0 for x in vectors["b"]) == 1
    by_model = {r.key: r.embedding for r in retrieve.model_embeddings(df, "key", "text", lambda: lambda texts: np.array([[len(t), 0.0] for t in texts])).collect()}
    assert by_model == {"a": [1.0, 0.0], "b": [1.0, 0.0], "c": None, "d": [0.0, 0.0], "e": [1.0, 0.0]}
    with pytest.raises(ValueError):
        retrieve.top_similar(spark.range(retrieve.MOST_QUERIES + 1).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding")), spark.range(1).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding")), 1)


def test_stream_resumes(spark, tmp_path):
    schema = T._parse_datatype_string("chunk_id string, embed_text string, chunk_text string")
    asked = tmp_path / "asked"

    def ask(prompt, budget):
        with open(asked, "a") as log:
            log.write(prompt.removeprefix("Q: ") + "\n")
        if "hỏng" in prompt:
            raise RuntimeError
        return '{"entities": [], "relations": []}', True

    for n, rows in enumerate(([("a", "", "căn cứ A"), ("b", "", "không")], [("a", "", "căn cứ A"), ("c", "", "căn cứ hỏng"), ("d", "", "căn cứ D")])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        extract_new(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp{0}", ask, "Q: {content}", schema)
    extract_new(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp{0}", ask, "Q: {content}", schema)
    results = [r.chunk_id for r in spark.read.parquet(f"{tmp_path}/out/*").collect()]
    assert sorted(results) == ["a", "d"] and sorted(set(asked.read_text().split("\n"))) == ["", "căn cứ A", "căn cứ D", "căn cứ hỏng"]
    assert asked.read_text().count("căn cứ A") == 1


def test_entry_point(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "statute_chunks" in entry.queries()


def test_pipelines(spark, tmp_path):
    from tessera.plans.corpus import STATUTE_TABLES, Job, chunk_and_link, load_judgments, load_statutes, report_chunks, report_judgments, report_statutes

    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    article = {"record_id": "r1", "article_id": "Điều 1", "article_title": "T", "chapter_title": "C", "topic_id": "1", "topic_number": "1", "subject_id": "s", "subject_number": "2", "content_text": "Theo Luật số 1/2030/QH16, điều 5.", "content_char_len": "9", "content_word_count": "3", "source_links_json": '[{"text":"Luật số 1/2030","href":"?ItemID=7"}]', "topic_title_vi": "own", "subject_title_vi": "own", "source_note_text": None, "related_note_text": None, "source_url": None, "scraped_at": "x"}
    tables = {
        "articles": [article],
        "ontology_topics": [{"topic_id": "1", "topic_title_vi": "Chủ đề", "topic_title_en": "e", "topic_note": "n", "ord": "1"}],
        "ontology_subjects": [{"subject_id": "s", "subject_title_vi": "Đề mục", "subject_title_en": "e", "ord": "1"}],
    }
    for name in STATUTE_TABLES:
        rows = tables.get(name, [{"id": "1", "note": None}])
        spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in rows[0])).write.parquet(f"{raw}/{name}.parquet")
    judgment = {c: "" for c in ("doc_name", "doc_code", "precedent_number", "title", "subject", "case_type", "doc_type", "court_level", "jurisdiction", "applied_article_code", "principle_text", "detail_url", "markdown", "text_hash", "parser_model")} | {"doc_name": "d"}
    df = spark.createDataFrame([tuple(judgment.values())], ", ".join(f"{c} string" for c in judgment))
    df.select("*", F.lit(2030).cast("long").alias("year"), F.lit(5).cast("long").alias("applied_article_number"), F.lit(0).cast("long").alias("applied_article_clause"), F.lit(4).cast("long").alias("char_len")).write.parquet(f"{raw}/documents.parquet")
    spark.createDataFrame([("d", "p", "findings", "text", "0", "0.0", "Câu dài hơn mười chữ.")], "doc_name string, paragraph_id string, section_kind string, paragraph_kind string, index_in_paragraph string, global_index string, text string").write.parquet(f"{raw}/sentences.parquet")
    unified = load_statutes(spark, Job(raw, out))
    assert unified.first().hierarchy_path == "Chủ đề > Đề mục > C > T"
    judgments, _ = load_judgments(spark, Job(raw, out))
    nodes, edges = chunk_and_link(spark, Job(out, out))
    assert {(r.id, r.label) for r in nodes.collect()} >= {("r1", "ARTICLE"), ("d", "AN_LE"), ("VBPL::7", "ENTITY"), ("ENT::DIEU::điều 5", "ENTITY"), ("ENT::VBPL::luật số 1/2030/qh16", "ENTITY")}
    assert {r.type for r in edges.collect()} == {"BELONGS_TO", "MENTIONS", "APPLIES_ARTICLE", "THUOC"}
    assert all(df.count() >= 0 for df in [*report_statutes(unified).values(), *report_judgments(judgments).values(), report_chunks(spark.read.parquet(f"{out}/statute_chunks.parquet"))])


def test_raw_articles_and_missing_inputs(spark, tmp_path):
    """Articles as they are published: links are arrays, topics have counts and no order, records have other names."""
    from tessera.plans.corpus import STATUTE_TABLES, Job, chunk_and_link, extract, load_statutes

    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    columns = "record_id string, article_id string, article_title string, chapter_title string, topic_id string, topic_number long, topic_title_vi string, topic_title string, subject_id string, subject_number long, subject_title_vi string, subject_title string, content_text string, content_char_len long, content_word_count long, source_note_text string, related_note_text string, source_links array<struct<text:string,href:string>>, source_url string, scraped_at string, article_anchor string"
    row = ("r1", "Điều 1", "T", "C", "1", 1, "", None, "s", 2, "own", None, "Căn cứ Luật số 1/2030/QH16, điều 5.", 9, 3, None, None, [("Luật số 1/2030", "?ItemID=7"), (None, None)], None, "x", None)
    spark.createDataFrame([row, row[:17] + (None,) + row[18:]], columns).write.parquet(f"{raw}/articles.parquet")
    spark.createDataFrame([("1", "Chủ đề", "e", "n", 3, 2)], "topic_id string, topic_title_vi string, topic_title_en string, topic_note string, article_count long, demuc_count long").write.parquet(f"{raw}/ontology_topics.parquet")
    spark.createDataFrame([("s", "", "e", 3)], "subject_id string, subject_title_vi string, subject_title_en string, article_count long").write.parquet(f"{raw}/ontology_subjects.parquet")
    for name in set(STATUTE_TABLES) - {"articles", "ontology_topics", "ontology_subjects"}:
        spark.createDataFrame([("1", None)], "id string, note string").write.parquet(f"{raw}/{name}.parquet")
    unified = load_statutes(spark, Job(raw, out))
    assert sorted(r.source_links_json for r in unified.collect()) == ['[]', '[{"text":"Luật số 1/2030","href":"?ItemID=7"},{"text":"","href":""}]']
    assert unified.first().hierarchy_path == "Chủ đề > own > C > T" and len(unified.columns) == 23

    def model(context, content, budget):
        return '{"entities": [{"name": "Luật A", "type": "VBPL"}], "relations": []}', True

    nodes, edges = chunk_and_link(spark, Job(out, out), model)  # there are no judgments and no earlier results
    assert "ENT::VBPL::luật a" in {r.id for r in nodes.collect()} and {r.label for r in nodes.collect()} == {"CHUNK", "ARTICLE", "ENTITY"}
    chunks = spark.read.parquet(f"{out}/statute_chunks.parquet")
    entities, _, failed = extract(spark, Job(out, str(tmp_path / "again")), [chunks], lambda *args: 1 / 0)
    assert failed.count() == 0 and [r.name for r in entities.collect()] == ["Luật A"]  # nothing is asked twice
    broken = extract(spark, Job(str(tmp_path / "none"), str(tmp_path / "again")), [chunks], lambda *args: 1 / 0)
    assert broken[0].count() == 0 and [r.error for r in broken[2].collect()] == ["ZeroDivisionError"]


def test_a_cluster_needs_a_shared_folder():
    from tessera.session import cut_lineage

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Frame:
        class sparkSession:
            sparkContext = Context()
            conf = {}

    with pytest.raises(ValueError):
        cut_lineage(Frame())


def test_vectors_on_chunks(spark):
    chunks = spark.createDataFrame([("a", 5), ("b", None)], "chunk_id string, n int")
    vectors = spark.createDataFrame([("a", [2.0]), ("a", [1.0])], "key string, embedding array<float>")
    assert [(r.chunk_id, r.embedding) for r in retrieve.with_vectors(chunks, vectors).orderBy("chunk_id").collect()] == [("a", [1.0]), ("b", None)]
    assert [r.cut_off for r in retrieve.cut_off(chunks, "n", 4).orderBy("chunk_id").collect()] == [True, False]
