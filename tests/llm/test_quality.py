import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.llm.quality import TAILS, document_statistics, not_prose, outlier_scores, sentence_share
from tessera.llm.registry import p8_found, p8_scores

PROSE = "Người nộp đơn phải bổ sung giấy xác nhận cư trú trước phiên hòa giải. Nếu hồ sơ còn thiếu, cơ quan tiếp nhận trả lại và nêu rõ lý do."
JUNK = ["Xã Re Hiểu,\nXã Mữc Miềng,\nẤp Hiệt Sềo,", "| Cột 1 | Cột 2 |\n|---|---|\n| bản kê | 4977 |", "Lệ phí: 2155\nBút lục: x\nMã thửa: 58%", "=G9H+CG56CGfdD2b7G8facB+edHF7BFDD8EgB3dg56"]


def test_layout_does_not_change_sentences():
    lined = PROSE.replace(". ", ".\n- ")
    wrapped = "Người nộp đơn phải bổ sung giấy xác nhận cư trú\ntrước phiên hòa giải. Nếu hồ sơ còn thiếu, cơ quan\ntiếp nhận trả lại và nêu rõ lý do."
    for text in (PROSE, lined, wrapped, PROSE.lower()):
        assert sentence_share(text) > 0.9
    for text in JUNK:
        assert sentence_share(text) < 0.1
    assert sentence_share("") == 0.0


def frames(spark):
    texts = [PROSE] * 20 + JUNK + [None, "", "ok"]
    rows = [(i, t, "vi" if i % 5 else " VI ", 1) for i, t in enumerate(texts)] + [(100, PROSE, None, 1), (101, JUNK[0], "xx", 1)]
    words = spark.createDataFrame([("vi", "và"), ("vi", "phải"), ("vi", "nếu"), ("en", "the"), (None, "x")], "lang string, word string")
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int"), words


def test_ranks_and_scores_against_brute_force(spark):
    documents, words = frames(spark)
    scored = outlier_scores(document_statistics(documents, words)).toPandas()
    assert len(scored) == 27 and set(scored.lang) == {"vi", "other"}
    for _, group in scored.groupby("lang"):
        total = 0
        for name, side in TAILS.items():
            low, high = group[name].rank(method="max") / len(group), (-group[name]).rank(method="max") / len(group)
            total = total - np.log(low if side == "low" else high if side == "high" else np.minimum(low, high))
        assert np.allclose(total, group.score)


def test_what_is_not_prose(spark):
    documents, words = frames(spark)
    found = {r.doc_id for r in not_prose(documents, words, least_score=0.5, least_texts=1).collect()}
    assert {20, 21, 22, 23} <= found and not found & set(range(20))
    assert {r.doc_id for r in not_prose(documents, words).collect()} >= found  # too few texts to stand out from: all are checked
    assert not_prose(documents.limit(0), words).count() == 0


def test_enumerations_are_no_sentences():
    inline = "Danh mục: " + "; ".join(["bản vẽ mặt cắt đê (Tằp Ngiềp)"] * 12) + "."
    lines = "bản kê tài sản, giấy xác nhận cư trú, sổ theo dõi kho lạnh\n" * 20 + "Theo quy định tại khoản 2 Điều 283, đơn vị thi công phải bổ sung biên lai lệ phí."
    wrapped = "Hội\nđồng định giá phải bổ sung bản đồ ranh giới cho người đại diện hợp pháp ở xã Lẩy Ghơi,\ntrong thời hạn 14 ngày làm việc."
    assert sentence_share(inline) < 0.1 and sentence_share(lines) < 0.2 and sentence_share(wrapped) > 0.9


def found_in(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    frames(spark)[1].write.parquet(f"{folder}/common_words.parquet")
    return {r.doc_id for r in p8_found(spark, str(folder)).collect()}


def test_low_scores_hide_no_junk(spark, tmp_path):
    rows = [(i, PROSE, "vi") for i in range(10)] + [(10, JUNK[0], "en"), (11, None, "vi"), (12, "", "vi")]
    assert found_in(spark, tmp_path, rows) == {10}


def test_copies_of_one_junk_text_hide_nothing(spark, tmp_path):
    prose = [(i, PROSE.replace("hồ sơ", f"hồ sơ số {i}"), "vi") for i in range(110)]
    rows = prose + [(200 + i, JUNK[1], None) for i in range(55)] + [(300, PROSE, "und")]
    assert found_in(spark, tmp_path, rows) == set(range(200, 255))
    scores = {r.doc_id: r.score for r in p8_scores(spark, str(tmp_path)).collect()}
    assert min(scores[i] for i in range(200, 255)) > 12 > max(scores[i] for i in range(110))


def test_repeated_keys_are_scored_by_row(spark):
    documents, words = frames(spark)
    rows = outlier_scores(document_statistics(documents.withColumn("doc_id", F.when(F.col("doc_id") > 21, F.lit(1))), words))
    assert rows.count() == 27
    expected = sorted(r.score for r in outlier_scores(document_statistics(documents, words)).collect())
    assert np.allclose(sorted(r.score for r in rows.collect()), expected)
