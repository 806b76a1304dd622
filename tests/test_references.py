import pytest

from tessera.operators.references import merged_validity, orphan_counts, orphan_references
from tessera.queries_references import p5_counts, p5_found


def times(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    for c in df.columns:
        if c in ("t", "s", "e"):
            df = df.withColumn(c, df[c].cast("timestamp_ntz"))
    return df


PARENTS = [("a", "x", "2030-01-01", None), ("a", "x", "2030-01-01", None), ("b", "x", "2030-01-01", "2030-02-01"), ("b", "x", "2030-03-01", None), ("c", "x", "2030-06-01", None), ("d", "x", "2030-02-01", "2030-01-01"), ("e", "x", None, None), (None, "x", "2030-01-01", None)]
REFERENCES = [(1, "a", "2030-01-01"), (2, "b", "2030-02-01"), (3, "b", "2030-03-05"), (4, "c", "2030-05-31"), (5, "z", "2030-01-01"), (6, None, "2030-01-01"), (7, "", "2030-01-01"), (8, "a", None), (9, "d", "2031-01-01"), (10, "e", "2031-01-01"), (5, "z", "2030-01-01"), (11, "a", "2029-12-31")]


def both(spark):
    return times(spark, REFERENCES, "ref long, key string, t string"), times(spark, PARENTS, "key string, reason string, s string, e string")


def test_reasons(spark):
    refs, parents = both(spark)
    found = orphan_references(refs, parents, [("key", "key")], "t", "s", "e")
    got = sorted((r.ref, r.reason) for r in found.collect())
    assert got == [(2, "deleted"), (4, "late"), (5, "missing"), (5, "missing"), (7, "missing"), (8, "late"), (9, "deleted"), (10, "late"), (11, "late")]
    counts = orphan_counts(found, "refs", "t", "key")
    assert {(r.period, r.reason, r.n) for r in counts.collect()} >= {("2030-01", "missing", 3), (None, "late", 1)}


def test_spans_are_merged(spark):
    parents = times(spark, [("k", "2030-01-01", "2030-02-01"), ("k", "2030-01-15", "2030-03-01"), ("k", "2030-04-01", "2030-05-01"), ("k", "2030-04-10", None), ("k", "2030-06-01", "2030-07-01")], "key string, s string, e string")
    spans = sorted((str(r.span_start)[:10], str(r.span_end)[:10]) for r in merged_validity(parents, ["key"], "s", "e").collect())
    assert spans == [("2030-01-01", "2030-03-01"), ("2030-04-01", "None")]


@pytest.mark.parametrize("match, expected", [("simple", {3}), ("partial", {3, 4, 5}), ("full", {2, 3, 4, 5})])
def test_null_masks(spark, match, expected):
    refs = times(spark, [(1, "a", "p", "2030-05-01"), (2, "a", None, "2030-05-01"), (3, "a", "q", "2030-05-01"), (4, None, "q", "2030-05-01"), (5, "z", None, "2030-05-01"), (6, None, None, "2030-05-01")], "ref long, k1 string, k2 string, t string")
    parents = times(spark, [("a", "p", "2030-01-01", None), ("b", None, "2030-01-01", None)], "k1 string, k2 string, s string, e string")
    found = orphan_references(refs, parents, [("k1", "k1"), ("k2", "k2")], "t", "s", "e", match)
    assert {r.ref for r in found.collect()} == expected


def test_empty_tables(spark):
    refs, parents = both(spark)
    assert orphan_references(refs.limit(0), parents, [("key", "key")], "t", "s", "e").count() == 0
    assert {r.reason for r in orphan_references(refs, parents.limit(0), [("key", "key")], "t", "s", "e").collect()} == {"missing"}
    with pytest.raises(ValueError):
        orphan_references(refs, parents, [("key", "key")], "t", "s", "e", "none")


def test_a_name_without_a_chunk_is_missing(spark, tmp_path):
    stamps = ("extracted_at", "retracted_at", "loaded_at", "deleted_at")
    tables = {
        "edges": ("edge_id long, target_id string, loaded_at string", []),
        "nodes": ("id string, loaded_at string, deleted_at string", []),
        "extracted_entity": ("chunk_id string, name string, extracted_at string, retracted_at string", [("c", "A", "2030-01-01", None), (None, "A", "2030-01-01", None)]),
        "extracted_relation": ("relation_id long, chunk_id string, source string, target string, extracted_at string", [(1, "c", "A", " a ", "2030-01-05"), (2, None, "A", "", "2030-01-05"), (3, None, None, "A", "2030-02-05")]),
    }
    for name, (schema, rows) in tables.items():
        df = spark.createDataFrame(rows, schema)
        df = df.withColumns({c: df[c].cast("timestamp_ntz") for c in stamps if c in df.columns})
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    found = sorted(tuple(r) for r in p5_found(spark, str(tmp_path)).collect())
    assert found == [("extracted_relation", 2, "source", "2030-01", "missing"), ("extracted_relation", 3, "target", "2030-02", "missing")]
    assert sum(r.n for r in p5_counts(spark, str(tmp_path)).collect()) == 2
