"""Text functions on columns, evaluated in the JVM. White space is Unicode's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


# The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space at both ends; null stays null."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def safe(text: Column) -> Column:
    """Null as '', white space stripped (PRJ5)."""
    return strip(F.coalesce(text.cast("string"), F.lit("")))


def clean_lead(text: Column) -> Column:
    """Without the marks and white space that a cut leaves at the head, and stripped (STR6)."""
    return strip(F.ltrim(text, F.lit(WHITE_SPACE + ".;,:")))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for a blank text (STR15)."""
    return let(strip(text), lambda bare: F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"(?U)\s+")))).cast("long")


def path(*parts: Column) -> Column:
    """'A > B > C' of the parts that are not blank; equal neighbours stay (STR11)."""
    return F.concat_ws(" > ", F.filter(F.array(*[safe(p) for p in parts]), lambda p: p != ""))


def distinct_neighbours(parts: Column) -> Column:
    """An array without the entries that equal the entry kept before them (WIN3)."""
    return F.aggregate(
        parts, F.array().cast("array<string>"), lambda kept, part: F.when((F.size(kept) > 0) & (F.try_element_at(kept, F.lit(-1)) == part), kept).otherwise(F.concat(kept, F.array(part)))
    )


def context_prefix(*parts: Column) -> Column:
    """The path without repeated neighbours and with a line end; '' if every part is blank (STR12)."""
    kept = distinct_neighbours(F.filter(F.array(*[safe(p) for p in parts]), lambda p: p != ""))
    return F.when(F.size(kept) == 0, F.lit("")).otherwise(F.concat(F.concat_ws(" > ", kept), F.lit("\n")))


# How the sections of a judgment are labelled.
SECTION_LABELS = {
    "case_summary": "Tóm tắt vụ án",
    "findings": "Nhận định của Toà án",
    "decision": "Quyết định",
    "header": "Phần đầu",
    "footer": "Phần cuối",
    "principle": "Nguyên tắc pháp lý",
}


def section_prefix(case_type: Column, title: Column, subject: Column, section: Column) -> Column:
    """'[case] title (subject) | Phần: label' and a line end; an unknown section labels itself (STR13)."""
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in SECTION_LABELS.items() for x in pair]), section), section)
    case, subject = safe(case_type), safe(subject)
    parts = F.array(
        F.when(case != "", F.concat(F.lit("["), case, F.lit("]"))).otherwise(""),
        safe(title),
        F.when(subject != "", F.concat(F.lit("("), subject, F.lit(")"))).otherwise(""),
        F.concat(F.lit("| Phần: "), label),
    )
    return F.concat(F.concat_ws(" ", F.filter(parts, lambda p: p != "")), F.lit("\n"))


def entity_id(kind: Column, name: Column) -> Column:
    """'ENT::TYPE::name', the name stripped and in lower case (STR21)."""
    return F.concat(F.lit("ENT::"), kind, F.lit("::"), F.lower(strip(name)))


def context_of(embed_text: Column, content: Column) -> Column:
    """What stands before the content in an embedded text; all of it if the content is empty or not its end (STR24)."""
    embed, own = F.coalesce(embed_text, F.lit("")), F.coalesce(content, F.lit(""))
    return F.when((own != "") & F.endswith(embed, own), F.substring(embed, F.lit(1), F.length(embed) - F.length(own))).otherwise(embed)


# Fixed value: the instruction that queries, and only they, are embedded with.
QUERY_INSTRUCTION = "Instruct: Given a Vietnamese legal question, retrieve relevant legal passages that answer the question\nQuery: "


def query_text(question: Column) -> Column:
    """A question as it is embedded (STR26)."""
    return F.concat(F.lit(QUERY_INSTRUCTION), question)
