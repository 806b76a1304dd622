"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.canonical import look_alike_pairs
from tessera.llm.mixing import distinct_texts, reached_shares, select_mix
from tessera.llm.names import link_spellings, spelling_pairs
from tessera.llm.packing import fill_report, pack
from tessera.llm.quality import CLAUSE_WORDS, TAILS, document_statistics, not_prose, outlier_scores
from tessera.llm.splitting import WHITE_SPACE, oversized, with_pieces
from tessera.llm.tokens import with_tokens
from tessera.llm.vectors import most_similar, neighbour_pairs
from tessera.session import cut_lineage, spread
from tessera.sources.tables import read_table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different spellings of one bearer."""
    return spelling_pairs(link_spellings(read_table(spark, folder, "extracted_entity"), "mention_id", "name", "type"))


def p1_bearers(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling with its bearer."""
    return link_spellings(read_table(spark, folder, "extracted_entity"), "mention_id", "name", "type")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks of which at least one is among the five most similar of the other."""
    similar = most_similar(read_table(spark, folder, "chunk"), "chunk_id", "embedding")
    return neighbour_pairs(similar).select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of articles, and of entity names, that look the same in different characters."""
    articles = look_alike_pairs(read_table(spark, folder, "phapdien_unified"), "doc_id", "content_text")
    mentions = read_table(spark, folder, "extracted_entity").where(F.col("name").isNotNull())
    names = look_alike_pairs(mentions.groupBy("name").agg(F.min("mention_id").alias("mention_id")), "mention_id", "name")
    return articles.select(F.lit("phapdien_unified").alias("source_table"), "key_a", "key_b").unionByName(
        names.select(F.lit("extracted_entity").alias("source_table"), "key_a", "key_b")
    )


SPLIT_TABLES = (("phapdien_unified", "content_text"), ("anle_unified", "content_markdown"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Oversized texts, and whether a piece had to be cut inside a run without white space."""
    parts = []
    for table, column in SPLIT_TABLES:
        pieces = with_pieces(oversized(read_table(spark, folder, table), "doc_id", column), "text", "pieces")
        cut = F.when(F.exists("pieces", lambda p: p.cut == "hard"), "hard").otherwise("boundary")
        parts.append(pieces.select(F.lit(table).alias("source_table"), "doc_id", cut.alias("cut")))
    return parts[0].unionByName(parts[1])


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every oversized text."""
    parts = []
    for table, column in SPLIT_TABLES:
        pieces = with_pieces(oversized(read_table(spark, folder, table), "doc_id", column), "text", "pieces")
        parts.append(pieces.select(F.lit(table).alias("source_table"), "doc_id", F.inline_outer("pieces")).where("piece IS NOT NULL"))
    return parts[0].unionByName(parts[1])


def p4_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Per oversized text: its length without outer white space as its pieces span it, and what must not be: pieces over the limit, pieces
    that are not what stands at their place, characters left out, overlaps that are too wide."""
    parts = []
    for table, column in SPLIT_TABLES:
        rows = with_pieces(oversized(read_table(spark, folder, table), "doc_id", column), "text", "pieces")
        pairs = F.zip_with(F.slice("pieces", 1, F.size("pieces") - 1), F.slice("pieces", 2, F.size("pieces") - 1), lambda a, b: F.struct(a.end.alias("end"), b.start.alias("start")))
        between = F.transform(pairs, lambda p: F.when(p.start > p.end, F.col("text").substr(p.end + 1, p.start - p.end)).otherwise(""))
        number = lambda array, wrong: F.size(F.filter(array, wrong))
        parts.append(
            rows.where(F.size("pieces") > 0).select(
                F.lit(table).alias("source_table"),
                "doc_id",
                (F.element_at("pieces", -1).end - F.element_at("pieces", 1).start).cast("long").alias("n_chars"),
                number("pieces", lambda p: F.length(p.text) > 1000).alias("too_long"),
                number("pieces", lambda p: p.text != F.col("text").substr(p.start + 1, p.end - p.start)).alias("altered"),
                number(between, lambda gap: F.btrim(gap, F.lit(WHITE_SPACE)) != "").alias("left_out"),
                number(pairs, lambda p: p.end - p.start > 150).alias("wide_overlaps"),
            )
        )
    return parts[0].unionByName(parts[1])


def sized_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, n_tokens) of every document."""
    documents = spread(read_table(spark, folder, "documents").select("doc_id", "source", "text"))
    return with_tokens(documents, "text").select("doc_id", "source", "n_tokens")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in containers of every kind, mixed like the targets."""
    shares = {r.source: r.target_share for r in read_table(spark, folder, "mix_targets").collect()}
    return pack(cut_lineage(sized_documents(spark, folder)), read_table(spark, folder, "pack_limits"), shares)


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How well the containers are filled."""
    return fill_report(p6_containers(spark, folder))


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind of container: the packed texts, and what must not be: texts packed in part or twice, overfull containers, texts split
    although they fit into one."""
    packed = cut_lineage(p6_containers(spark, folder))
    sizes = sized_documents(spark, folder).where("n_tokens > 0").select("doc_id", "n_tokens")
    texts = packed.groupBy("container_kind", "capacity", "doc_id").agg(F.sum("size").alias("size"), F.count("*").alias("n")).join(sizes, "doc_id", "left")
    per_kind = texts.groupBy("container_kind").agg(
        F.count("*").alias("texts"),
        F.count_if(F.coalesce(F.col("size") != F.col("n_tokens"), F.lit(True))).alias("broken"),
        F.count_if(F.col("n") > F.ceil(F.col("n_tokens") / F.col("capacity"))).alias("split_needlessly"),
    )
    full = packed.groupBy("container_kind", "window", "container").agg(F.sum("size").alias("size"), F.first("capacity").alias("capacity"))
    return per_kind.join(full.groupBy("container_kind").agg(F.count_if(F.col("size") > F.col("capacity")).alias("overfull")), "container_kind")


def p7_caps(spark: SparkSession, folder: str) -> DataFrame:
    """Per source, whether a text of it is used more often than allowed and how many are chosen twice; a source without a target that has
    texts would come out without share."""
    each = p7_selection(spark, folder).where("source IS NOT NULL").groupBy("source", "doc_id").agg(F.max("copies").alias("copies"), F.count("*").alias("n"))
    used = each.groupBy("source").agg(F.max("copies").alias("most"), F.count_if(F.col("n") > 1).alias("twice"))
    both = read_table(spark, folder, "mix_targets").join(used, "source", "full")
    return both.select("source", "target_share", "max_repeats", (F.coalesce("most", F.lit(0)) > F.col("max_repeats")).alias("over_cap"), F.coalesce("twice", F.lit(0)).alias("chosen_twice"))


def p7_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of the mix with their copies and memberships."""
    texts = with_tokens(distinct_texts(spread(read_table(spark, folder, "documents")), "doc_id", "text", "source"), "text")
    return select_mix(cut_lineage(texts), read_table(spark, folder, "mix_targets"))


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that are used, and how often."""
    return p7_mixed(spark, folder).drop("posterior")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share that each source reaches."""
    return reached_shares(cut_lineage(p7_mixed(spark, folder)), read_table(spark, folder, "mix_targets"))


#: A language of fewer texts is too small for ranks of its own.
LEAST_TEXTS = 100


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Quality statistics and outlier score of every text."""
    statistics = document_statistics(spread(read_table(spark, folder, "documents")), read_table(spark, folder, "common_words"))
    scored = outlier_scores(cut_lineage(statistics), "digest", LEAST_TEXTS)
    return scored.withColumn("score", F.round("score", 6)).drop("digest")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that are not natural prose: they stand out by the ranks of their statistics, and most of them is no sentence."""
    documents = read_table(spark, folder, "documents").select("doc_id", "text", "lang")
    return not_prose(spread(documents), read_table(spark, folder, "common_words")).select("doc_id")


_WHITE = "\\x{9}-\\x{D}\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


# Fixed values of the SQL, written down apart from the operator's: letters, hyphens and spaces that look plain, and what is not seen.
_SPACES = "\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_CYRILLIC, _AS_CYRILLIC = "АВЕКМНОРСТУХІЈЅҮԚԜаеорсухіјѕһԁԛԝү", "ABEKMHOPCTYXIJSYQWaeopcyxijshdqwy"
_GREEK, _AS_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj"
_STROKES, _AS_STROKES = "ÐƉ", "ĐĐ"
_DASHES = "\u2010\u2011\u2043\ufe63\u2212"
_WRITTEN = _CYRILLIC + _GREEK + _STROKES + _DASHES + _SPACES + _WIDE
_PLAIN = _AS_CYRILLIC + _AS_GREEK + _AS_STROKES + "-" * len(_DASHES) + " " * len(_SPACES) + "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)
_UNSEEN = "[\\x{AD}\\x{34F}\\x{61C}\\x{180B}-\\x{180F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FE00}-\\x{FE0F}\\x{FEFF}\\x{E0100}-\\x{E01EF}]"
_FORM = f"""nfc_normalize(translate(regexp_replace(t, '{_UNSEEN}', '', 'g'), '{_WRITTEN.replace("'", "''")}', '{_PLAIN.replace("'", "''")}'))"""

def sql_ratio(part: str, whole: str, places: int = 10_000) -> str:
    return f"floor(({part} * {2 * places} + greatest({whole}, 1)) / (2 * greatest({whole}, 1))) / {places}"


_CLAUSE = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(CLAUSE_WORDS))
_SIDES = {"low": "upto", "high": "from_on", "both": "least(upto, from_on)"}
_STATISTICS = f"""d AS (
      SELECT doc_id, text, CASE WHEN lower(trim(lang)) IN (SELECT lang FROM common_words) THEN lower(trim(lang)) ELSE 'other' END AS lang,
        list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> '') AS words, list_filter(regexp_split_to_array(text, '[\\r\\n]+'), lambda x: trim(x) <> '') AS lines
      FROM documents WHERE text <> ''
    ), c AS (SELECT lang, list(word) AS common FROM common_words GROUP BY 1 UNION ALL SELECT 'other', list(DISTINCT word) FROM common_words
    ), counted AS (
      SELECT doc_id, lang, text, len(words) AS n, length(text) AS chars, length(array_to_string(words, '')) AS letters, len(regexp_extract_all(text, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\s\\x{{B}}]')) AS symbols,
        len(regexp_extract_all(text, '\\p{{N}}')) AS digits, len(lines) AS lines, len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…;:,]["''”’»)\\]]*[\\s\\x{{B}}]*$'))) AS marks,
        len(list_filter(words, lambda w: list_contains(common, w))) AS common, len(list_filter(words, lambda w: list_contains([{_CLAUSE}], w))) AS clause, len(list_distinct(words)) AS different
      FROM d JOIN c USING (lang)
    ), st AS (
      SELECT doc_id, lang, text, CAST(n AS DOUBLE) AS word_count, {sql_ratio('letters', 'n', 100)} AS mean_word_length, {sql_ratio('symbols', 'chars')} AS symbol_ratio, {sql_ratio('digits', 'chars')} AS digit_ratio,
        {sql_ratio('marks', 'lines')} AS punctuated_lines, {sql_ratio('common', 'n')} AS common_words, {sql_ratio('clause', 'n')} AS clause_words, {sql_ratio('different', 'n')} AS distinct_words FROM counted
    ), texts AS (SELECT DISTINCT ON (lang, text) * FROM st), own AS (SELECT lang FROM texts WHERE lang <> 'other' GROUP BY 1 HAVING count(*) >= {LEAST_TEXTS}
    ), pool AS (SELECT lang AS ranks, * FROM texts WHERE lang IN (SELECT lang FROM own) UNION ALL SELECT '*', * FROM texts
    ), v AS ({" UNION ALL ".join(f"SELECT ranks, '{s}' AS statistic, {s} AS value FROM pool" for s in TAILS)}
    ), r AS (SELECT ranks, statistic, value, count(*) AS k FROM v GROUP BY ALL
    ), t AS (SELECT ranks, statistic, value, sum(k) OVER (PARTITION BY ranks, statistic ORDER BY value) AS upto, sum(k) OVER (PARTITION BY ranks, statistic ORDER BY value DESC) AS from_on, sum(k) OVER (PARTITION BY ranks, statistic) AS whole FROM r
    ), p AS (SELECT ranks, statistic, value, -ln((CASE statistic {" ".join(f"WHEN '{s}' THEN {_SIDES[side]}" for s, side in TAILS.items())} END) / whole) AS part, whole FROM t)"""

QUERIES = {
    "p1_found": p1_found,
    "p1_bearers": p1_bearers,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_coverage": p4_coverage,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p6_packed": p6_packed,
    "p7_selection": p7_selection,
    "p7_shares": p7_shares,
    "p7_caps": p7_caps,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
}

SQL = {
    "p3_found": f"""WITH a AS (
          SELECT DISTINCT 'phapdien_unified' AS source_table, doc_id AS k, content_text AS t FROM phapdien_unified WHERE doc_id IS NOT NULL AND content_text IS NOT NULL
          UNION ALL SELECT 'extracted_entity', min(mention_id), name FROM extracted_entity WHERE name IS NOT NULL GROUP BY name
        ), f AS (SELECT source_table, k, t, {_FORM} AS f FROM a)
        SELECT DISTINCT x.source_table, x.k AS key_a, y.k AS key_b FROM f x JOIN f y ON x.source_table = y.source_table AND x.f = y.f AND x.k < y.k AND x.t <> y.t""",
    "p4_found": "\nUNION ALL\n".join(
        f"""SELECT '{table}' AS source_table, doc_id,
  CASE WHEN regexp_matches(min({column}), '[^{_WHITE}]{{1000}}[^{_WHITE}]') THEN 'hard' ELSE 'boundary' END AS cut
FROM {table} WHERE length({column}) > 1000 GROUP BY doc_id"""
        for table, column in SPLIT_TABLES
    ),
    "p4_coverage": "\nUNION ALL\n".join(
        f"""SELECT '{table}' AS source_table, doc_id, length(regexp_replace(min({column}), '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g')) AS n_chars, 0 AS too_long, 0 AS altered, 0 AS left_out, 0 AS wide_overlaps
FROM {table} WHERE length({column}) > 1000 AND doc_id IS NOT NULL GROUP BY doc_id HAVING regexp_matches(min({column}), '[^{_WHITE}]')"""
        for table, column in SPLIT_TABLES
    ),
    "p8_scores": f"""WITH {_STATISTICS}, ranked AS (SELECT row_number() OVER () AS row, st.*, CASE WHEN lang IN (SELECT lang FROM own) THEN lang ELSE '*' END AS ranks FROM st),
        long AS ({" UNION ALL ".join(f"SELECT row, ranks, '{s}' AS statistic, {s} AS value FROM ranked" for s in TAILS)}),
        scored AS (SELECT row, round(sum(part), 6) AS score, CAST(max(whole) AS BIGINT) AS ranked_among FROM long JOIN p USING (ranks, statistic, value) GROUP BY 1)
        SELECT ranked.* EXCLUDE (row, text, ranks), score, ranked_among FROM ranked JOIN scored USING (row)""",
    "p6_packed": "SELECT container_kind, (SELECT count(*) FROM documents WHERE text <> '') AS texts, 0 AS broken, 0 AS split_needlessly, 0 AS overfull FROM pack_limits",
    "p7_caps": "SELECT source, target_share, max_repeats, false AS over_cap, 0 AS chosen_twice FROM mix_targets",
}
