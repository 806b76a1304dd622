"""Retrieval over chunks: vectors, words, graph, and all of them fused."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import let

#: Query vectors held in memory by a task at a time, and at most in one search: a question set, not a whole collection.
QUERY_BLOCK, MOST_QUERIES = 1024, 65_536


def top_similar(queries: DataFrame, vectors: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, similarity, rank): the k vectors of highest cosine for each query vector, itself excluded (SRT4, RET1); exact.

    Queries are taken in blocks of a fixed size, each block against all vectors: a task keeps k rows per query of the block, so what is
    shuffled is k rows per query and task. Vectors that are null, hold nulls, differ in length from the query or are all zero take no
    part; equal similarities, to nine digits, are ordered by id.
    """
    id_type = vectors.schema[id_column].dataType.simpleString()
    sound = lambda df: df.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()) & F.exists(vector, lambda x: x != 0))
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries: compare them by an index")
    numbered = sound(queries).select(F.col(id_column).alias("query_id"), vector)
    blocks = numbered.withColumn("_block", F.floor((F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("query_id"), F.lit(64))).orderBy("query_id")) - 1) / (QUERY_BLOCK // 64)))
    out = None
    for number in sorted(r[0] for r in blocks.select("_block").distinct().collect()):
        rows = blocks.where(F.col("_block") == number).select("query_id", vector).collect()
        found = _search_block(sound(vectors), rows, k, id_column, vector, id_type)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {id_type}, id {id_type}, similarity double, rank int")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _search_block(vectors: DataFrame, rows: list, k: int, id_column: str, vector: str, id_type: str) -> DataFrame:
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r[vector]), []).append(r)
    packed = {n: ([r.query_id for r in rs], _unit(np.array([r[vector] for r in rs], dtype=np.float64))) for n, rs in by_size.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(packed)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}
        for batch in batches:
            for n, own in batch.groupby(batch[vector].map(len)):
                if n not in shared.value:
                    continue
                ids, points = shared.value[n]
                own_ids = own[id_column].to_numpy()
                scores = points @ _unit(np.stack(own[vector].to_numpy()).astype(np.float64)).T
                for i, query in enumerate(ids):
                    row = np.where(own_ids == query, -np.inf, scores[i])
                    edge = -np.partition(-row, min(k, len(row)) - 1)[min(k, len(row)) - 1]
                    top = np.flatnonzero(row >= edge - 1e-8)
                    merged = best.get(query, []) + [(-round(float(row[j]), 9), own_ids[j], float(row[j])) for j in top if np.isfinite(row[j])]
                    best[query] = sorted(merged)[:k]
        found = [(q, i, s) for q, hits in best.items() for _, i, s in hits]
        yield pd.DataFrame(found, columns=["query_id", "id", "similarity"])

    return vectors.select(id_column, vector).mapInPandas(search, f"query_id {id_type}, id {id_type}, similarity double")


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def terms(text: F.Column) -> F.Column:
    """The words of a text in lower case, as the index has them."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def inverted_index(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, length): how often a term stands in a document (RET2); null texts have no terms. Counted before the shuffle."""
    rows = documents.select(F.col(key).alias("key"), terms(F.coalesce(text, F.lit(""))).alias("_terms"))
    words = rows.select("key", F.size("_terms").alias("length"), F.explode_outer("_terms").alias("term")).where("term IS NOT NULL")
    return words.groupBy("term", "key").agg(F.count("*").alias("tf"), F.max("length").alias("length"))


def full_text(documents: DataFrame, question: str, k: int, key: str, text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score, rank): the k documents of highest BM25 for the words of a question; equals, to six digits, by key.

    Only the question's terms are exploded, so the scan keeps no other word. A repeated key counts as one document, the longest text.
    """
    wanted = sorted(set(re.findall(r"[^\W_]+", question.lower())))
    one = documents.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.coalesce(text, F.lit(""))).alias("_text"))
    rows = one.select("key", terms(F.col("_text")).alias("_terms")).withColumn("length", F.size("_terms"))
    whole = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    hits = rows.select("key", "length", F.explode_outer(F.filter("_terms", lambda w: w.isin(wanted))).alias("term")).where("term IS NOT NULL")
    tf = hits.groupBy("key", "term").agg(F.count("*").alias("tf"), F.max("length").alias("length"))
    df = {r.term: r.df for r in tf.groupBy("term").agg(F.count("*").alias("df")).collect()}  # as many rows as the question has words
    idf = F.lit(0.0)
    for term, n in df.items():
        idf = F.when(F.col("term") == term, F.lit(float(np.log(1 + (whole.n - n + 0.5) / (n + 0.5))))).otherwise(idf)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(float(whole["mean"] or 1))))
    scored = tf.groupBy("key").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "key").limit(k)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "key")))


def fused(rankings: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """(key, score): reciprocal rank fusion of rankings (key, rank) of a few rows each (RET4)."""
    each = reduce(DataFrame.unionByName, [r.select("key", "rank") for r in rankings])
    return each.groupBy("key").agg(F.round(F.sum(1 / (F.lit(constant) + F.col("rank"))), 9).alias("score")).orderBy(F.desc("score"), "key").limit(k)


def hashed_embeddings(passages: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """(key, embedding): unit vectors of signed feature hashing, a baseline that needs no model (UDF5; ``model_embeddings`` takes one).

    Every word adds one to, or takes one from, the place that its digest names. Null texts have a null vector, texts without words zeros.
    All is computed in the JVM.
    """
    words = F.filter(F.split(F.lower(F.col(text)), r"[\s\x0B]+"), lambda w: w != "")
    codes = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 3), 16, 10).cast("int"))

    def sums(codes: F.Column) -> F.Column:
        signed = lambda i: F.aggregate(codes, F.lit(0), lambda total, c: total + F.when(F.pmod(c, F.lit(size)) == i, F.when(c >= 2048, 1).otherwise(-1)).otherwise(0))
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), signed)

    def unit(sums: F.Column) -> F.Column:
        norm = F.sqrt(F.aggregate(sums, F.lit(0), lambda total, x: total + x * x))
        return let(norm, lambda n: F.transform(sums, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")))

    vector = let(codes, lambda c: let(sums(c), unit))  # each computed once, however often it is named
    return passages.select(F.col(key).alias("key"), F.when(F.col(text).isNotNull(), vector).alias("embedding"))


def model_embeddings(passages: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """(key, embedding) by a model (UDF5): ``load`` runs once per task and gives a function from texts to rows of numbers, which gets Arrow
    batches. Vectors are made of unit length; null texts have a null vector."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            known = batch.dropna()
            if len(known):
                rows = np.asarray(model(known.tolist()), dtype=np.float64)
                norms = np.linalg.norm(rows, axis=1, keepdims=True)
                for i, row in zip(known.index, rows / np.where(norms > 0, norms, 1)):
                    out[i] = row.astype(np.float32)
            yield out

    return passages.select(F.col(key).alias("key"), embed(F.col(text)).alias("embedding"))


def with_vectors(chunks: DataFrame, embeddings: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks with the ``embedding`` of (key, embedding), null where there is none (SNK11); of several vectors of a key the smallest counts."""
    one = embeddings.groupBy(F.col("key").alias("_key")).agg(F.min("embedding").alias("embedding"))
    return chunks.drop("embedding").join(one, F.col(key) == F.col("_key"), "left").drop("_key")


def cut_off(chunks: DataFrame, length: str, limit: int) -> DataFrame:
    """Adds ``cut_off``: whether a passage is longer than a model takes (FLT11); a null length is not."""
    return chunks.withColumn("cut_off", F.coalesce(F.col(length) > limit, F.lit(False)))
