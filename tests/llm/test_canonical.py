import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.canonical import canonical_text, look_alike_pairs, with_canonical


def test_what_looks_the_same_becomes_the_same():
    pairs = [("Ｈｏ̣̂ｉ đồng", "Hội đồng"), ("số\xa08／2", "số 8/2"), ("Сhế bіến", "Chế biến"), ("a​b­c", "abc"), ("Ðặng", "Đặng"), ("x‐y‑z", "x-y-z"), ("ế", "ế"), ("Т. Нa", "T. Ha")]
    for written, plain in pairs:
        assert canonical_text(written) == plain


def test_what_can_be_seen_stays():
    for text in ("m² ½ № °", "Hà ha HÀ", "a\r\nb\tc", "𠮷田", "соглашение", "", "2/3"):
        assert canonical_text(text) == text


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_form_is_stable_and_composed(text):
    once = canonical_text(text)
    assert canonical_text(once) == once
    assert unicodedata.is_normalized("NFC", once)


@given(st.text(alphabet="aàảeêếoộ dđ.̀̂", max_size=30))
@settings(max_examples=200, deadline=None)
def test_coding_of_accents_does_not_matter(text):
    assert canonical_text(unicodedata.normalize("NFD", text)) == canonical_text(unicodedata.normalize("NFC", text))


def test_columns_and_pairs(spark):
    rows = [("d1", "Tòa án", 1), ("d2", "Tòa án", 2), ("d2", "Tòa án", 3), ("d3", "Tòa án", 4), ("d4", None, 5), (None, "Tòa​ án", 6), ("d5", "", 7), ("d6", "​", 8), ("d7", "x" * 100_000, 9)]
    df = spark.createDataFrame(rows, "id string, text string, key_a int")
    formed = {(r.key_a): r.form for r in with_canonical(df, "text", "form").collect()}
    assert formed[2] == "Tòa án" and formed[5] is None and formed[8] == "" and formed[9] == "x" * 100_000
    assert sorted(map(tuple, look_alike_pairs(df, "id", "text").collect())) == [("d1", "d2"), ("d2", "d3"), ("d5", "d6")]
    assert look_alike_pairs(df.limit(0), "id", "text").count() == 0


def test_bidi_controls_and_variation_selectors_are_removed():
    for code in (0x202A, 0x202E, 0x2066, 0x2069, 0xFE0F, 0xE0100, 0xE01EF, 0x061C, 0x180B):
        assert canonical_text(f"Tòa{chr(code)} án") == "Tòa án"
