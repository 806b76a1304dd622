import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.text import clean_lead, context_of, context_prefix, path, section_prefix, word_count
from tessera.operators.chunking import STATUTE_META, clauses, judgment_chunks, merge_short, pack_sections, paragraphs, sentences_of, split_recursively, statute_chunks


def one(spark, column, **values):
    schema = ", ".join(f"{n} string" for n in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column).first()[0]


def test_clause_boundaries(spark):
    text = "Điều 1 intro\n1. " + "a" * 20 + "\n2. Bãi bỏ.\n3. \n" + "b" * 20
    assert one(spark, clauses(F.col("t")), t=text) == ["Điều 1 intro\n1. " + "a" * 20 + "\n2. Bãi bỏ.", "3. \n" + "b" * 20]
    assert one(spark, clauses(F.col("t")), t="no clause here") == ["no clause here"]
    assert one(spark, clauses(F.col("t")), t="") == [] and one(spark, clauses(F.col("t")), t=None) == []


def merged(pieces, least=80):
    if len(pieces) <= 1:
        return pieces
    out, carry = [], ""
    for piece in pieces:
        text = f"{carry}\n{piece}" if carry else piece
        carry = text if len(text) < least else ""
        if not carry:
            out.append(text)
    if carry:
        out = [*out[:-1], f"{out[-1]}\n{carry}"] if out else [carry]
    return out


def test_merging_against_a_loop(spark):
    random.seed(0)
    rows = [([c * random.choice([3, 30, 79, 80, 100]) for c in "abcdefgh"[: random.randint(0, 8)]],) for _ in range(200)] + [(["a" * 5],)]
    got = spark.createDataFrame(rows, "p array<string>").select("p", merge_short(F.col("p")).alias("m")).collect()
    assert all(r.m == merged(r.p) for r in got)


@given(st.text(alphabet="ab .;,\n", max_size=400))
@settings(max_examples=200, deadline=None)
def test_recursive_pieces_fit_and_lose_nothing(text):
    pieces = split_recursively(text, 30, 8)
    assert all(0 < len(p) <= 30 for p in pieces)
    at = 0
    for piece in pieces:
        assert piece in text
    assert set("".join(pieces)) == set(text) - set("\n ") | (set("".join(pieces)) & set("\n ")) and at == 0


def article(**values):
    return {c: "" for c in STATUTE_META} | {"doc_id": "d", "article_id": "x", "topic_title_vi": "A", "subject_title_vi": "A", "article_title": "B"} | values


def statute(spark, *rows):
    schema = ", ".join(f"{c} string" for c in [*STATUTE_META, "content_text", "chunks"])
    return statute_chunks(spark.createDataFrame([tuple({**article(), "chunks": "extra", **r}.get(c) for c in [*STATUTE_META, "content_text", "chunks"]) for r in rows], schema))


def test_statute_chunks(spark):
    long = "2. " + "câu dài. " * 200
    rows = statute(spark, {"content_text": "1. " + "a" * 100 + "\n" + long}, {"doc_id": "e", "content_text": "ngắn thôi"}, {"doc_id": "f", "content_text": None}, {"doc_id": "g", "content_text": "nan"}, {"doc_id": "h", "content_text": " \n"}).orderBy("doc_id", "chunk_index").collect()
    own = [r for r in rows if r.doc_id == "d"]
    assert [r.chunk_type for r in own] == ["khoan", "split", "split"] and own[2].chunk_text.startswith("[...2.] ") and not own[1].chunk_text.startswith("[")
    assert [r.chunk_index for r in own] == [0, 1, 2] and {r.chunk_total for r in own} == {3}
    assert own[0].chunk_id == "d::x::chunk::0" and own[0].embed_text.startswith("A > B\n1. ")
    assert [r.chunk_type for r in rows if r.doc_id == "e"] == ["full"] and {r.doc_id for r in rows} == {"d", "e"}


def packed(spark, sizes, section="findings", first=None):
    found = ([{"text": first, "section": "header"}] if first else []) + [{"text": "x" * n, "section": section} for n in sizes]
    df = spark.createDataFrame([(found,)], "p array<struct<text:string,section:string>>")
    return [len(p.text) for p in df.select(pack_sections(F.col("p"))).first()[0]]


def test_packing_limits(spark):
    assert packed(spark, [499, 500]) == [499, 500]  # the first run counts one more
    assert packed(spark, [990, 499, 500]) == [990, 1000]
    assert packed(spark, [499, 500], first="head") == [1000]
    assert packed(spark, []) == []


def sentence(doc, paragraph, i, text, section="findings", at=None):
    return (doc, paragraph, section, "text", i, at if at is not None else i, text)


SENTENCES = "doc_name string, paragraph_id string, section_kind string, paragraph_kind string, index_in_paragraph long, global_index long, text string"


def test_paragraphs_keep_their_order(spark):
    rows = [sentence("d", "p2", 0, ". Hai", at=5), sentence("d", "p1", 1, "ba", at=2), sentence("d", "p1", 0, "Một", at=1), sentence("d", "p3", 0, " ", at=9), sentence(None, "p1", 0, "x"), sentence("d", None, 0, "x"), sentence("d", "p4", 0, None, at=10)]
    assert [p.text for p in paragraphs(spark.createDataFrame(rows, SENTENCES)).first().paragraphs] == ["Một ba", "Hai"]


def test_judgment_chunks(spark):
    from tessera.operators.chunking import JUDGMENT_META

    columns = [*JUDGMENT_META, "principle_text", "content_markdown"]
    rows = [tuple({"doc_id": d, "title": "T", "case_type": "c", "principle_text": p, "content_markdown": "# H\n\n## A\nMột hai. Ba.\n## B\n" + "câu. " * 300}.get(c) for c in columns) for d, p in (("d", "nguyên tắc"), ("e", None))]
    rows.append(tuple({"doc_id": "n", "principle_text": "p"}.get(c) for c in columns))
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    got = judgment_chunks(df, sentences_of(df)).orderBy("doc_id", "chunk_index").collect()
    d = [r for r in got if r.doc_id == "d"]
    assert d[0].chunk_id == "d::chunk::principle" and d[1].chunk_id == "d::chunk::0" and [r.chunk_index for r in d] == list(range(len(d)))
    assert d[0].embed_text.startswith("[Nguyên tắc pháp lý] [c] T | Phần: Nguyên tắc pháp lý\n") and {r.chunk_total for r in d} == {len(d)}
    assert {r.doc_id for r in got} == {"d", "e"} and all(r.chunk_char_len <= 1000 for r in got)


def test_text_functions(spark):
    assert one(spark, path(F.col("a"), F.col("b"), F.col("c")), a=" A ", b=None, c="A") == "A > A"
    assert one(spark, context_prefix(F.col("a"), F.col("b"), F.col("c")), a="A", b="", c="A") == "A\n"
    assert one(spark, context_prefix(F.col("a")), a=None) == ""
    assert one(spark, clean_lead(F.col("a")), a=" .; a b ") == "a b"
    assert one(spark, word_count(F.col("a")), a=" a b\n") == 2 and one(spark, word_count(F.col("a")), a="  ") == 0
    assert one(spark, section_prefix(F.col("a"), F.col("b"), F.col("c"), F.lit("odd")), a="", b="T", c=None) == "T | Phần: odd\n"
    assert one(spark, context_of(F.col("a"), F.col("b")), a="P\nx", b="x") == "P\n" and one(spark, context_of(F.col("a"), F.col("b")), a="P", b="") == "P"
