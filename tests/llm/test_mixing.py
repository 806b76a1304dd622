from tessera.llm.mixing import distinct_texts, fit_rates, reached_shares, select_mix, source_posteriors

TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("none", 0.1, 1), (None, 0.5, 1), ("zero", 0.0, 5)]


def frames(spark):
    words = {"a": "biển tàu cá", "b": "rừng cây gỗ", "c": "phố nhà đất"}
    rows = []
    for i in range(1200):
        s = "a" if i % 10 < 7 else "b" if i % 10 < 9 else "c"
        rows.append((i, None if i % 37 == 0 else s, f"{words[s]} {i} " * (1 + i % 5), 10 + i % 50))
    rows += [(5000, "other", "khác", 5), (5001, "a", "trống", None), (5002, "b", "không", 0)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, n_tokens long"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    texts, targets = frames(spark)
    chosen = select_mix(texts, targets)
    rows = chosen.collect()
    caps = {s: m for s, _, m in TARGETS}
    assert all(1 <= r.copies <= caps.get(r.source, 1) for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    assert not {r.doc_id for r in rows} & {5000, 5001, 5002}
    reached = {r.source: r.reached_share for r in reached_shares(chosen, targets).collect()}
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(reached[source] - share) < 0.02
    assert (reached["none"] or 0) < 1e-6


def test_posteriors_find_the_source(spark):
    texts, _ = frames(spark)
    labelled = texts.where("source IN ('a', 'b', 'c') AND doc_id % 3 > 0").select("source", "text")
    held = texts.where("source IN ('a', 'b', 'c') AND doc_id % 3 = 0")
    got = source_posteriors(labelled, held.select("doc_id", "text"), ["a", "b", "c"]).join(held.select("doc_id", "source"), "doc_id").collect()
    assert sum("abc"[r.posterior.index(max(r.posterior))] == r.source for r in got) / len(got) > 0.95
    assert all(abs(sum(r.posterior) - 1) < 1e-9 for r in got)


def test_rates_meet_goals_with_soft_membership(spark):
    members = spark.createDataFrame([(100.0, 1.0, [1.0, 0.0]), (100.0, 3.0, [0.0, 1.0]), (50.0, 1.0, [0.5, 0.5])], "tokens double, cap double, posterior array<double>")
    from pyspark.sql import functions as F

    from tessera.llm.mixing import _rate

    history = fit_rates(members, [80.0, 200.0])
    got = members.withColumn("r", _rate(history)).agg(*[F.sum(F.col("r") * F.col("tokens") * F.col("posterior")[i]) for i in range(2)]).first()
    assert abs(got[0] - 80) < 1 and abs(got[1] - 200) < 1


def test_texts_and_empties(spark):
    texts, targets = frames(spark)
    rows = [(3, "b", "x"), (1, None, "x"), (2, "a", "x"), (4, "a", ""), (5, "a", None), (6, "a", "y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert sorted((r.doc_id, r.source) for r in distinct_texts(df, "doc_id", "text", "source").collect()) == [(2, "a"), (6, "a")]
    assert select_mix(texts.limit(0), targets).count() == 0 and select_mix(texts, targets.limit(0)).count() == 0
