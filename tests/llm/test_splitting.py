import random
import re

from tessera.llm.splitting import WHITE_SPACE, RangeMaximum, oversized, split_text, with_pieces


def test_range_maximum_against_brute_force():
    import numpy as np

    values = np.random.default_rng(0).integers(0, 5, 300).astype(np.int8)
    table = RangeMaximum(values, 64)
    for low in range(0, 236, 7):
        for high in range(low, low + 64):
            best = max(range(low, high + 1), key=lambda i: (values[i], i))
            assert table.last_max(low, high) == best


def test_random_texts_keep_every_rule():
    random.seed(1)
    for _ in range(1500):
        parts = [random.choice("ab .\n ;1)") if random.random() < 0.5 else "x" * random.randint(1, 45) for _ in range(random.randint(0, 300))]
        text = "".join(parts)
        pieces = split_text(text, 40, 6, 15)
        assert all(len(p[4]) <= 40 and p[4] == text[p[1] : p[2]] for p in pieces)
        for a, b in zip(pieces, pieces[1:]):
            assert not text[a[2] : b[1]].strip(WHITE_SPACE) and b[1] > a[1] and b[2] > a[2] and a[2] - b[1] <= 6
        if len(text.strip(WHITE_SPACE)) > 40:
            assert any(p[3] == "hard" for p in pieces) == bool(re.search(rf"[^{WHITE_SPACE}]{{41,}}", text))


def test_cuts_prefer_strong_boundaries():
    text = "Mở đầu dài " + "chữ " * 20 + "\n1. " + "khoản " * 12 + "hết."
    pieces = split_text(text, 110, 20, 40)
    assert pieces[0][3] == "clause" and "1. khoản" in pieces[1][4]


def test_columns(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", " \n "), ("d", "chữ " * 600), ("d", "chữ " * 600), (None, "y" * 2000), ("e", "z" * 1001)], "doc_id string, text string")
    rows = {r.doc_id: r.pieces for r in with_pieces(df, "text", "pieces").collect()}
    assert rows["a"] is None and rows["b"] == [] and rows["c"] == [] and len(rows["d"]) == 3
    assert [p.cut for p in rows["e"]] == ["hard", "end"]
    assert sorted(r.doc_id for r in oversized(df, "doc_id", "text").collect()) == ["d", "e"]
    assert with_pieces(df.limit(0), "text", "pieces").count() == 0
