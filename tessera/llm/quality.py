"""Quality statistics of documents, exact ranks of them per language, and outlier scores from the ranks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.canonical import canonical_text
from tessera.llm.running import running_totals
from tessera.session import cut_lineage

#: The tail of each statistic in which junk lies.
TAILS = {
    "word_count": "both",
    "mean_word_length": "both",
    "symbol_ratio": "high",
    "digit_ratio": "high",
    "punctuated_lines": "low",
    "common_words": "low",
    "clause_words": "low",
    "distinct_words": "both",
}
#: The statistics whose tails tell lists, tables and junk from prose best; the others describe a text.
SELECTING = ("symbol_ratio", "punctuated_lines", "clause_words", "distinct_words")

# Words and phrases that a Vietnamese, English or French clause is built on.
PREDICATES = {
    "phải", "không", "chịu", "đã", "chưa", "cần", "sẽ", "khi", "nếu", "nên", "thì", "vì", "gửi", "nộp", "lập", "ghi", "có thể", "có nghĩa vụ",
    "có trách nhiệm", "có quyền", "có hiệu lực", "chuyển giao", "đối chiếu", "đề nghị", "trình bày", "yêu cầu", "theo quy định", "căn cứ",
    "may", "shall", "must", "is", "are", "was", "were", "has", "have", "had", "be", "not", "can", "will", "if",
    "peut", "doit", "est", "sont", "ne", "n'est", "peuvent", "doivent", "sera", "ont", "a",
}

_LETTERS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\Z")
_EDGE = " \t\r\n.,;:!?()[]\"'“”‘’«»…*-–—+•/"
_MARKER = re.compile(r"^\s*(?:[-+*•·]\s+|\(?\d{1,3}[.)/]\s+|\(?\w[.)/]\s+|#{1,6}\s+|\[\d+\]\s*|(?:Điều|Chương|Mục|Article)\s+\w{1,5}(?:[.:]\s+|\s*$))")
_END = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*(?=\s|$)")
_TABULAR = re.compile(r"[|\t]|<\w+>|</\w+>|;[^ \n]|,[^ \d\n]|\S {3,}\S|\.{4,}")


def _without_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).replace("đ", "d")


_PLAIN_PREDICATES = {_without_accents(p) for p in PREDICATES} - {"da", "can", "nen", "lap", "vi"}
#: The single words of the predicates, with and without accents.
CLAUSE_WORDS = {p for p in PREDICATES | _PLAIN_PREDICATES if " " not in p}


@cache
def _predicate() -> re.Pattern:
    """A predicate in words joined by blanks, in lower case."""
    return re.compile(f" (?:{'|'.join(sorted(PREDICATES, key=len, reverse=True))}) ")


@cache
def _plain_predicate() -> re.Pattern:
    return re.compile(f" (?:{'|'.join(sorted(_PLAIN_PREDICATES, key=len, reverse=True))}) ")


def _has_predicate(words: list[str]) -> bool:
    pattern = _predicate() if any(not w.isascii() for w in words) else _plain_predicate()
    return pattern.search(f" {' '.join(words)} ") is not None


def _words_of(text: str) -> list[str]:
    return [t.lower() for t in (w.strip(_EDGE) for w in text.split()) if _LETTERS.match(t)]


def _segments(text: str) -> Iterator[tuple[str, bool]]:
    """Candidate sentences, and whether each stands alone on its line.

    A line is wrapped, and continued by the next, if it is long and ends without punctuation, the next line bears no marker, and neither
    looks like a row of a table. A capital continues only what has a predicate: before it, the entries of a list end."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    parts: list[str] = []
    for line in lines:
        before = parts[-1] if parts else ""
        bare = line.strip()
        joined = before and bare and not _TABULAR.search(before) and not _TABULAR.search(line) and not before.rstrip().endswith((".", "!", "?", "…", ";", ":"))
        if joined and not _MARKER.match(line) and len(before.split("\n")[-1]) >= 35 and not (bare[0].isupper() and "," in before and not _has_predicate(_words_of(before))):
            parts[-1] = f"{before}\n{line}"
        else:
            parts.append(line)
    for part in parts:
        sentences = [s for s in _END.split(_MARKER.sub("", part, count=1)) if s.strip()]
        for sentence in sentences:
            yield sentence, len(sentences) == 1


def _is_sentence(segment: str) -> tuple[bool, bool]:
    """Whether a segment reads as a full sentence, and whether it has a predicate that the lists know."""
    bare = segment.strip().rstrip("\"'”’»)]")
    if not bare.endswith((".", "!", "?", "…", ";")) or _TABULAR.search(bare):
        return False, False
    tokens = [t.strip(_EDGE) for t in bare.split()]
    tokens = [t for t in tokens if t]
    words = [t.lower() for t in tokens if _LETTERS.match(t)]
    odd = sum(1 for t in tokens if not _LETTERS.match(t) and not re.fullmatch(r"[\d.,/%:²m-]+|\d+\w{0,3}", t))
    if len(words) < 6 or len(words) < 0.6 * len(tokens) or odd > 0.2 * len(tokens):
        return False, False
    predicate = _has_predicate(words)
    # Without a predicate, what semicolons part or end is an enumeration.
    return predicate or bare.count(";") == 0, predicate


def sentence_share(text: str) -> float:
    """The share of the characters that belong to full sentences, layout characters included.

    A sentence ends in a mark, has at least six words, is made of words and not of garbled signs, and is no row of a table. Three or
    more segments that stand alone on their lines are judged together: if few of them have a known predicate, they are entries of a list.
    """
    if not text:
        return 0.0
    text = canonical_text(text)
    flowing, alone, alone_known, alone_all, entries = 0, 0, 0, 0, 0
    for segment, single in _segments(text):
        full, known = _is_sentence(segment)
        if not full:
            continue
        if single:
            alone += len(segment) + 1
            alone_known += len(segment) * known
            alone_all += len(segment)
            entries += 1
        else:
            flowing += len(segment)
    if entries >= 3 and alone_known < 0.3 * alone_all:
        alone = 0
    return min(1.0, (flowing + alone) / max(1, len(text)))


@F.pandas_udf(T.DoubleType())
def _sentence_share(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(sentence_share, na_action="ignore").astype("float64")


def language(column: str, known: tuple[str, ...]) -> Column:
    """A language code in lower case, 'other' if it is null or not known."""
    code = F.lower(F.trim(F.col(column)))
    return F.when(code.isin(*known), code).otherwise("other")


def _among(words: list[str]):
    return lambda word: word.isin(words)


def _listed(common_words: DataFrame) -> dict[str, list[str]]:
    """The words of each language of a short fixed list."""
    listed: dict[str, list[str]] = {}
    for row in common_words.select("lang", "word").where("lang IS NOT NULL AND word IS NOT NULL").distinct().collect():
        listed.setdefault(row.lang, []).append(row.word)
    return listed


def language_codes(common_words: DataFrame) -> tuple[str, ...]:
    return tuple(sorted(_listed(common_words))) or ("other",)


def document_statistics(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document that is neither null nor empty: key, language, a digest of the text and the statistics named in ``TAILS``.

    Ratios are rounded to four places, the mean length to two. A text without words has mean length and ratios of 0. Repeated rows
    stay repeated. All is computed in the JVM. The common words (lang, word) are a short fixed list that
    reaches every task as a literal; a document of an unknown language is held against all of them. Clause words are the single words
    of ``PREDICATES``, with and without accents.
    """
    listed = _listed(common_words)
    known = tuple(sorted(listed)) or ("other",)
    kept = documents.where(F.col(text) != "").select(F.col(key).alias("doc_id"), F.col(text).alias("text"), language(lang, known).alias("lang"))
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    rows = kept.withColumn("_words", words).withColumn("_lines", F.filter(F.split("text", r"[\r\n]+"), lambda x: F.trim(x) != ""))
    n, chars = F.size("_words"), F.length("text")
    common = F.lit(0)
    for code, own in [*sorted(listed.items()), ("other", sorted({w for ws in listed.values() for w in ws}))]:
        common = F.when(F.col("lang") == code, F.size(F.filter("_words", _among(own)))).otherwise(common)
    marks = F.size(F.filter("_lines", lambda x: x.rlike(r"[.!?…;:,][\"'”’»)\]]*\s*$")))
    # Rounded by whole numbers, so that every engine rounds alike.
    ratio = lambda part, whole, places=10_000: F.floor((part * (2 * places) + F.greatest(whole, F.lit(1))) / (2 * F.greatest(whole, F.lit(1)))) / places
    letters = F.length(F.array_join("_words", ""))
    return rows.select(
        "doc_id",
        "lang",
        digest(F.col("text")).alias("digest"),
        n.cast("double").alias("word_count"),
        ratio(letters, n, 100).alias("mean_word_length"),
        ratio(F.regexp_count("text", F.lit(r"[^\p{L}\p{M}\p{N}\s]")), chars).alias("symbol_ratio"),
        ratio(F.regexp_count("text", F.lit(r"\p{N}")), chars).alias("digit_ratio"),
        ratio(marks, F.size("_lines")).alias("punctuated_lines"),
        ratio(common, n).alias("common_words"),
        ratio(F.size(F.filter("_words", _among(sorted(CLAUSE_WORDS)))), n).alias("clause_words"),
        ratio(F.size(F.array_distinct("_words")), n).alias("distinct_words"),
    )


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def tail_probabilities(statistics: DataFrame, names: tuple[str, ...] = tuple(TAILS)) -> DataFrame:
    """Per language, statistic and value: the number of documents with that value, how many lie below it and at or above it, of how many.

    The values are sorted by range partitions; every partition counts on from the total of those before it, so the ranks are exact and
    no partition holds a whole language. Equal values are counted before the sort.
    """
    long = statistics.select("lang", _long(names))
    counted = long.groupBy("lang", "statistic", "value").agg(F.count("*").alias("n"))
    placed = running_totals(counted, ["lang", "statistic"], "value", "n", "below")
    totals = placed.groupBy("lang", "statistic").agg(F.sum("n").alias("of"))
    return placed.join(totals, ["lang", "statistic"]).withColumn("at_least", F.col("of") - F.col("below"))


def _long(names: tuple[str, ...]) -> Column:
    return F.inline(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in names]))


#: The name under which the ranks of the whole corpus stand.
CORPUS = "*"


def outlier_scores(statistics: DataFrame, text: str | None = None, least_texts: int = 1, names: tuple[str, ...] = tuple(TAILS)) -> DataFrame:
    """The statistics with ``score``: the sum of minus the logarithm of the tail probabilities of the statistics ``names`` in its
    language; and ``ranked_among``: the number of texts that it was ranked among.

    The tail is the one named in ``TAILS``; for 'both' the smaller of the two counts. Every row is scored by its values, so repeated and
    null keys do no harm; a single document of a language scores 0. With ``text``, a column that is equal for equal texts, a text counts
    once per language however many rows hold it. With ``least_texts`` above 1, 'other' and languages of fewer texts take the ranks of the
    whole corpus. Rows are reduced to distinct values before the ranks are joined; a hot value is split by AQE.
    """
    texts = statistics if text is None else statistics.dropDuplicates(["lang", text])
    ranked, rows = texts.select("lang", *names), statistics.withColumn("_ranks", F.col("lang"))
    if least_texts > 1:
        # One row per known language, so the join by this hint stays small.
        own = F.broadcast(texts.where("lang != 'other'").groupBy("lang").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_texts).select("lang", F.lit(True).alias("_own")))
        rows = statistics.join(own, "lang", "left").withColumn("_ranks", F.when(F.col("_own"), F.col("lang")).otherwise(CORPUS)).drop("_own")
        ranked = ranked.join(own, "lang", "left_semi").unionByName(ranked.withColumn("lang", F.lit(CORPUS)))
    ranks = tail_probabilities(ranked, names)
    low, high = (F.col("below") + F.col("n")) / F.col("of"), F.col("at_least") / F.col("of")
    tail = F.lit(None)
    for name in names:
        tail = F.when(F.col("statistic") == name, {"low": low, "high": high, "both": F.least(low, high)}[TAILS[name]]).otherwise(tail)
    scores = ranks.select(F.col("lang").alias("_ranks"), "statistic", "value", (-F.ln(tail)).alias("part"), "of")
    values = ["_ranks", *names]
    long = rows.select(*values).distinct().select("*", _long(names))
    summed = long.join(scores, ["_ranks", "statistic", "value"]).groupBy(*values).agg(F.sum("part").alias("score"), F.max("of").alias("ranked_among"))
    return rows.join(summed, values).select(*statistics.columns, "score", "ranked_among")


def suspects(scored: DataFrame, least_score: float, least_texts: int) -> DataFrame:
    """(digest, lang) of the texts that stand out by their score; of fewer than ``least_texts`` none can, so there all are suspects."""
    return scored.where((F.col("score") >= least_score) | (F.col("ranked_among") < least_texts)).select("digest", "lang").distinct()


def not_prose(documents: DataFrame, common_words: DataFrame, least_score: float = 4.0, most_sentences: float = 0.5, least_texts: int = 100) -> DataFrame:
    """Rows (doc_id, sentence_share) of documents (doc_id, text, lang) that stand out from the prose of their language by the ranks of
    their statistics and, checked exactly, have less than ``most_sentences`` of their characters in sentences.

    The check runs on the suspects alone. Null and empty texts take no part, copies of a text share its verdict, a repeated or null key
    comes out as often as it comes in. The score tells outliers: where more than a third of the different texts of a language are of
    one and the same kind of junk, they are no outliers any more, and a lower ``least_score`` is needed.
    """
    known = language_codes(common_words)
    statistics = cut_lineage(document_statistics(documents, common_words).select("lang", "digest", *SELECTING))
    stand_out = suspects(outlier_scores(statistics, "digest", least_texts, SELECTING), least_score, least_texts)
    rows = documents.where(F.col("text") != "").select("doc_id", "text", digest(F.col("text")).alias("digest"), language("lang", known).alias("lang"))
    judged = _sentence_share.asNondeterministic()("text")  # a deterministic one would be moved before the join, to all texts
    checked = rows.join(stand_out, ["digest", "lang"], "left_semi").select("doc_id", judged.alias("sentence_share"))
    return checked.where(F.col("sentence_share") < most_sentences)
