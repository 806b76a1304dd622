"""A selection of documents in which every source has its target share of the tokens.

A document belongs to its source, or, where that is not known, to each source with the probability that a naive Bayes classifier of
the labelled documents gives it. Rates of use between 0 and a cap are fitted by projected-gradient least squares, so that the expected
token totals of the sources meet their targets; then rates are turned into whole copies.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.running import running_totals
from tessera.session import cut_lineage

BUCKETS = 1 << 16


def distinct_texts(documents: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One row (doc_id, source, n_tokens, text) per different text, since a text under two ids is one text: the smallest id, one with a
    known source first. Null and empty texts take no part."""
    rows = documents.where(F.col(text) != "").select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = rows.withColumn("_digest", F.sha2("text", 256))
    first = rows.groupBy("_digest").agg(F.min(F.struct(F.col("source").isNull(), F.col("doc_id"))).alias("_first")).select("_first.doc_id")
    return rows.join(first, "doc_id", "left_semi").drop("_digest")


def _bucket_counts(texts: DataFrame, keys: list[str]) -> DataFrame:
    words = F.explode_outer(F.split(F.lower("text"), r"[^\p{L}\p{M}\p{N}]+"))
    exploded = texts.select(*keys, words.alias("word")).where("word != ''")
    return exploded.groupBy(*keys, F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).alias("bucket")).agg(F.count("*").alias("n"))


def source_posteriors(labelled: DataFrame, unlabelled: DataFrame, sources: list[str], weight: float = 30.0) -> DataFrame:
    """(doc_id, posterior) for every unlabelled (doc_id, text): an array of probabilities in the order of ``sources``.

    Multinomial naive Bayes over hashed words, counted over all labelled (source, text). The evidence of a document counts as that of
    ``weight`` words, for its words are not independent. A document without words gets the priors.
    """
    counts = _bucket_counts(labelled, ["source"])
    sums = [F.sum(F.when(F.col("source") == s, F.col("n")).otherwise(0)).alias(f"s{i}") for i, s in enumerate(sources)]
    table = counts.groupBy("bucket").agg(*sums)
    words = table.agg(*[F.sum(f"s{i}") for i in range(len(sources))]).first()
    totals = [float(x or 0) + BUCKETS for x in words]
    priors = {r.source: r.n for r in labelled.groupBy("source").agg(F.count("*").alias("n")).collect()}  # as many rows as targets
    everything = max(1, sum(priors.get(s, 0) for s in sources))
    model = table.select("bucket", F.array(*[F.ln((F.col(f"s{i}") + 1) / F.lit(totals[i])) for i in range(len(sources))]).alias("likelihood"))
    unseen = F.array(*[F.lit(math.log(1 / t)) for t in totals])
    seen = _bucket_counts(unlabelled, ["doc_id"]).join(model, "bucket", "left").withColumn("likelihood", F.coalesce("likelihood", unseen))
    evidence = seen.groupBy("doc_id").agg(F.array(*[F.sum(F.col("n") * F.col("likelihood")[i]) / F.sum("n") for i in range(len(sources))]).alias("evidence"))
    prior = F.array(*[F.lit(math.log((priors.get(s, 0) + 1) / (everything + len(sources)))) for s in sources])
    scored = unlabelled.select("doc_id").join(evidence, "doc_id", "left")
    score = F.coalesce(F.zip_with("evidence", prior, lambda e, p: e * weight + p), prior)
    scored = scored.select("doc_id", score.alias("score")).withColumn("score", F.transform("score", lambda x: F.exp(x - F.array_max("score"))))
    total = F.aggregate("score", F.lit(0.0), lambda a, x: a + x)
    return scored.select("doc_id", F.transform("score", lambda x: x / total).alias("posterior"))


def _rate(history: list[list[float]], start: Column | None = None) -> Column:
    """The rate of a row (posterior, cap) after some steps: every step moves it along its expected residual and back into its bounds."""
    start = F.lit(0.0) if start is None else start
    if not history:
        return start
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in history])
    along = lambda step: F.aggregate(F.zip_with("posterior", step, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(steps, start, lambda rate, step: F.least(F.col("cap"), F.greatest(F.lit(0.0), rate + along(step))))


def fit_rates(members: DataFrame, goals: list[float], steps: int = 40, tolerance: float = 1e-4, written: int = 8) -> list[list[float]]:
    """The gradient steps that bring the expected totals of (tokens, cap, posterior) to the ``goals``; only totals reach the driver.

    The gradient of a source is scaled by the tokens that can belong to it, so one step suffices where no bound is met and memberships
    are certain. It ends when every residual is within ``tolerance`` of all goals together, or, with a warning, after ``steps``. The rates
    are written every ``written`` steps, so that no step repeats more than those.
    """
    size = len(goals)
    reach = members.agg(*[F.sum(F.col("tokens") * F.col("posterior")[i]) for i in range(size)]).first()
    history: list[list[float]] = []
    rated = members.withColumn("rate", F.lit(0.0))
    for step in range(steps + 1):
        totals = rated.agg(*[F.sum(F.col("rate") * F.col("tokens") * F.col("posterior")[i]) for i in range(size)]).first()
        residual = [g - float(t or 0) for g, t in zip(goals, totals)]
        if max(map(abs, residual)) <= tolerance * max(1.0, sum(goals)):
            break
        if step == steps:
            warnings.warn(f"rates are off by {max(map(abs, residual)):.0f} of {sum(goals):.0f} tokens after {steps} steps", stacklevel=2)
            break
        history.append([r / float(n) if n else 0.0 for r, n in zip(residual, reach)])
        rated = rated.withColumn("rate", _rate(history[-1:], F.col("rate")))
        if step % written == written - 1:
            rated = cut_lineage(rated)
    return history


def select_mix(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, copies, posterior) of every text (doc_id, source, text, n_tokens) that is used at least once.

    ``targets`` (source, target_share, max_repeats) is a short fixed list. The size of the selection is the largest at which the
    scarcest source, repeated as often as allowed, still has its share. Texts of a source without target are not used; those without a
    source are used at most once. Fractions of a rate become copies of the first texts by a hash order, up to the tokens they stand for.
    """
    wanted = {r.source: r for r in targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").collect()}
    sources = sorted(wanted)
    if not sources:
        return texts.select("doc_id", "source", "n_tokens", F.lit(0).alias("copies"), F.array().cast("array<double>").alias("posterior")).limit(0)
    sized = texts.where("n_tokens > 0")
    labelled, unlabelled = sized.where(F.col("source").isin(*sources)), sized.where(F.col("source").isNull())
    certain = F.array(*[F.when(F.col("source") == s, 1.0).otherwise(0.0) for s in sources])
    allowed = F.lit(1.0)
    for s in sources:
        allowed = F.when(F.col("source") == s, F.lit(float(wanted[s].max_repeats))).otherwise(allowed)
    known = labelled.select("doc_id", "source", "n_tokens", allowed.alias("cap"), certain.alias("posterior"))
    guessed = unlabelled.join(source_posteriors(labelled.select("source", "text"), unlabelled.select("doc_id", "text"), sources), "doc_id")
    guessed = cut_lineage(guessed.select("doc_id", F.lit(None).cast("string").alias("source"), "n_tokens", F.lit(1.0).alias("cap"), "posterior"))
    sums = known.groupBy("source", "cap", "posterior").agg(F.sum("n_tokens").cast("double").alias("tokens"))
    sums = cut_lineage(sums)
    have = {r.source: r.tokens for r in sums.select("source", "tokens").collect()}  # as many rows as targets
    share = sum(wanted[s].target_share for s in have)
    size = min((have[s] * wanted[s].max_repeats * share / wanted[s].target_share for s in have), default=0.0)
    goals = [size * wanted[s].target_share / share if s in have else 0.0 for s in sources]
    members = cut_lineage(sums.select("tokens", "cap", "posterior").unionByName(guessed.select(F.col("n_tokens").cast("double").alias("tokens"), "cap", "posterior")))
    rate = _rate(fit_rates(members, goals))
    rated = known.unionByName(guessed).withColumn("rate", rate).withColumn("queue", F.coalesce("source", F.lit("")))
    rated = rated.withColumn("_order", F.concat_ws("/", F.hex(F.xxhash64("doc_id")), "doc_id"))
    totals = rated.groupBy("queue").agg(F.sum("n_tokens").alias("_all"))
    placed = running_totals(rated, ["queue"], "_order", "n_tokens").join(F.broadcast(totals), "queue")  # as many rows as targets
    chance = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)
    fraction = F.col("rate") - F.floor("rate")
    extra = F.when(F.col("source").isNull(), chance < fraction).otherwise(F.col("before") + F.col("n_tokens") / 2 <= fraction * F.col("_all"))
    copies = (F.floor("rate") + extra.cast("long")).cast("int")
    return placed.select("doc_id", "source", "n_tokens", F.least(copies, F.col("cap").cast("int")).alias("copies"), "posterior").where("copies > 0")


def reached_shares(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: its share, the tokens and the texts selected, the most often a text is used, and the share reached. Texts without a
    source count for each source by its probability."""
    sources = sorted(r.source for r in targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").select("source").collect())
    each = F.inline(F.arrays_zip(F.array(*map(F.lit, sources)).alias("target"), F.col("posterior").alias("p")))
    parts = selected.select("n_tokens", "copies", F.col("source").isNotNull().alias("known"), each).where("p > 0")
    sums = parts.groupBy("target").agg(
        F.sum(F.col("n_tokens") * F.col("copies") * F.col("p")).alias("selected_tokens"), F.sum(F.col("known").cast("long")).alias("texts"), F.max("copies").alias("most_copies")
    )
    wide = targets.select("source", "target_share", "max_repeats").join(sums, targets["source"] == sums["target"], "left").drop("target")
    everything = F.sum("selected_tokens").over(Window.partitionBy())  # over as many rows as targets
    return wide.select("source", "target_share", "max_repeats", "selected_tokens", "texts", "most_copies", (F.col("selected_tokens") / everything).alias("reached_share"))
