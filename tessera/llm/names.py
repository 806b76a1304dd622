"""Variant spellings of names typed by people, linked by a trie join.

Names are read into forms: what tells bearers apart exactly (numbers, branch, office, relation to someone) and a core of plain
tokens. Forms are sharded by the tokens that variants within a bounded edit distance must share in any order; each shard is a trie of
the other tokens, walked by a Levenshtein automaton. Shards are complete for the bound: no two forms within it fail to meet.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import combinations, groupby, product

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.canonical import canonical_text
from tessera.operators.extract import ENTITY_TYPES
from tessera.session import cut_lineage

# Fixed values, all without accents: how Vietnamese names are put together.
OFFICES = {
    "uy ban nhan dan": "ubnd", "hoi dong nhan dan": "hdnd", "toa an nhan dan": "tand", "vien kiem sat nhan dan": "vksnd",
    "chi cuc thi hanh an dan su": "thads", "van phong dang ky dat dai": "vpdk", "phong cong chung": "pcc",
}
COMPANIES = {
    "cong ty trach nhiem huu han": "tnhh", "cty trach nhiem huu han": "tnhh", "cong ty co phan": "cp", "cty co phan": "cp",
    "doanh nghiep tu nhan": "dntn", "hop tac xa": "htx", "hop tac": "htx", "ngan hang thuong mai co phan": "nhtmcp",
}
SECTORS = ("xay dung", "thuong mai", "dich vu", "san xuat", "van tai", "thuy san", "che bien go", "dien luc", "dau tu")
LEVELS = {"tinh": "t", "thanh pho": "tp", "quan": "q", "huyen": "h", "xa": "x", "phuong": "p", "thi xa": "tx", "thi tran": "tt"}
RELATIONS = ("con trai", "con gai", "vo", "chong", "cac thua ke", "nguoi thua ke", "nguoi dai dien", "dai dien", "cong doan", "nguoi duoc uy quyen", "me", "bo", "cha")
TITLES = ("ong", "ba", "anh", "chi", "co", "chu", "bac", "em", "chau", "bi cao", "bi don", "nguyen don", "bi hai", "luat su", "nguoi lam chung", "dong chi")
RANKS = ("hai", "ba", "tu", "nam", "sau", "bay", "tam", "chin", "muoi", "ut", "ca")

FORM = T.StructType(
    [
        T.StructField("exact", T.StringType(), False),  # what must be the same
        T.StructField("level", T.StringType(), False),  # what must be the same if both have it
        T.StructField("kind", T.StringType(), False),  # full, initial or nick
        T.StructField("tokens", T.ArrayType(T.StringType()), False),
    ]
)


class Trie:
    """Words with values, searched with a Levenshtein automaton in which swapping neighbours is one edit."""

    def __init__(self):
        self.root: dict = {}

    def add(self, word: str, value) -> None:
        node = self.root
        for char in word:
            node = node.setdefault(char, {})
        node.setdefault(None, []).append(value)

    def near(self, word: str, distance: int) -> Iterator[tuple[int, object]]:
        """(edits, value) of every word within ``distance``. The automaton's state after d characters is the edit counts of the beginnings
        of ``word`` that are d - distance to d + distance long; subtrees that no state can leave within the distance are not entered."""
        size, over = len(word), distance + 1
        first = tuple(i if 0 <= i <= size else over for i in range(-distance, over))
        stack = [(self.root, 0, first, None, "")]
        while stack:
            node, depth, row, before, last = stack.pop()
            for char, child in node.items():
                if char is None:
                    at = size - depth + distance
                    if 0 <= at <= 2 * distance and row[at] <= distance:
                        for value in child:
                            yield row[at], value
                    continue
                following = _step(word, depth + 1, row, before, last, char, distance)
                if min(following) <= distance:
                    stack.append((child, depth + 1, following, row, char))


def _step(word: str, depth: int, row: tuple, before: tuple | None, last: str, char: str, distance: int) -> tuple:
    over, width, out = distance + 1, 2 * distance + 1, []
    for at in range(width):
        size = depth - distance + at
        if not 0 <= size <= len(word):
            out.append(over)
            continue
        cost = row[at + 1] + 1 if at + 1 < width else over
        if at:
            cost = min(cost, out[-1] + 1)
        if size:
            cost = min(cost, row[at] + (word[size - 1] != char))
        if size > 1 and before is not None and word[size - 1] == last and word[size - 2] == char:
            cost = min(cost, before[at] + 1)
        out.append(min(cost, over))
    return tuple(out)


_TELEX = re.compile(r"^([bcdghklmnpqrtvsx]{0,3}[aeiouy]+)(c|ch|m|n|ng|nh|p|t)?[sfrxj]$|^([bcdghklmnpqrtvsx]{0,3}[aeiouy]+)[sfrxj](c|ch|m|n|ng|nh|p|t)$")
_LATE_KEY = re.compile(r"(?<=[^\W\d_])([,)])[sfrxj](?=\s|$)")  # an accent's key typed after the mark
_NUMBER = re.compile(r"\d+(?:[./-]\d+)*(?:/[^\W\d_][\w-]*)?")
_ABBREVIATION = re.compile(r"(?<!\w)(?:[^\W\d_]\.){2,}[^\W\d_]?(?!\w)|(?<!\w)[^\W\d_](?:\.[^\W\d_])+(?!\w)")


@lru_cache(maxsize=200_000)
def plain(token: str) -> str:
    """A token without accents; keys typed for accents that were not turned into them are taken back."""
    flat = "".join(c for c in unicodedata.normalize("NFD", token.replace("đ", "d")) if not unicodedata.combining(c))
    flat = re.sub(r"([aeo])\1|(d)d", lambda m: m[1] or m[2], flat.replace("w", ""))
    found = _TELEX.match(flat) if token.isascii() else None
    return (found[1] or found[3]) + (found[2] or found[4] or "") if found else flat


def _shortened(phrase: str) -> set[str]:
    """A phrase run together, each word whole or as its first letter."""
    return {"".join(p) for p in product(*[(w, w[0]) for w in phrase.split()])}


@cache
def _heads() -> tuple[dict[str, tuple[str, str]], Trie]:
    """Offices, companies and decisions, however shortened, by the word run together."""
    exact, trie = {}, Trie()
    for kind, phrases in (("office", OFFICES), ("company", COMPANIES), ("decision", {"quyet dinh": "qd"})):
        for phrase, code in phrases.items():
            for word in _shortened(phrase) | ({"ctcp"} if code == "cp" else {"cttnhh"} if code == "tnhh" else set()):
                if len(word) > 1:
                    exact[word] = exact[plain(word)] = (kind, code)
                    trie.add(word, (kind, code))
    return exact, trie


@cache
def _head_runs() -> frozenset[str]:
    return frozenset(word[i : i + 3] for word in _heads()[0] for i in range(len(word) - 2))


@cache
def _head_forms() -> frozenset[str]:
    return frozenset(form for word in _heads()[0] for form in deletions(word, 1))


@lru_cache(maxsize=200_000)
def _misspelt_head(word: str) -> tuple[int, str, str] | None:
    """The nearest head, with its edits; short words cannot be misspelt."""
    allowed = 0 if len(word) < 7 else 1 if len(word) < 14 else 2
    # Cheap tests that every such word passes: two edits leave two runs of three letters, one edit a form with at most one letter less.
    if allowed == 2 and sum(word[i : i + 3] in _head_runs() for i in range(len(word) - 2)) < 2:
        return None
    if allowed == 1 and deletions(word, 1).isdisjoint(_head_forms()):
        return None
    return min(((edits, *value) for edits, value in _heads()[1].near(word, allowed)), default=None) if allowed else None


def _head(tokens: list[str]) -> tuple[str, str, int] | None:
    """The kind and code of the longest head that the tokens begin with, and its length; only if none is exact, the nearest one. Fewer
    than five tokens are too few for a misspelt head and a name."""
    words = ["".join(tokens[:n]) for n in range(1, min(len(tokens), 8) + 1)]
    for n in range(len(words), 0, -1):
        if words[n - 1] in _heads()[0]:
            return *_heads()[0][words[n - 1]], n
    best = None
    for n, word in enumerate(words, 1) if len(tokens) >= 5 else ():
        found = _misspelt_head(word)
        if found and (best is None or (found[0], -n) < best[0]):
            best = ((found[0], -n), found[1], found[2], n)
    return best[1:] if best else None


def _starts(tokens: list[str], phrases) -> str | None:
    """The longest phrase that the tokens begin with."""
    fitting = [p for p in phrases if tokens[: len(p.split())] == p.split()]
    return max(fitting, key=len) if fitting else None


def _reordered(text: str) -> str:
    """Other names in brackets are dropped; a head in brackets, after a dash or after a comma moves to the front. All other orders are left
    to the search."""
    inside = re.search(r"\(([^)]*)\)", text)
    if inside:
        rest = text.replace(inside[0], " ")
        tokens = [plain(t) for t in re.findall(r"[^\W\d_]+", inside[1])]
        return f"{inside[1]} {rest}" if tokens[:1] != ["tuc"] and _head(tokens) else rest
    parts = re.split(r"\s+[-–]\s+|\s*,\s*", text)
    if len(parts) == 2 and _head([plain(t) for t in re.findall(r"[^\W\d_]+", parts[1])]):
        return f"{parts[1]} {parts[0]}"
    return text


def read_name(name: str, kind: str) -> tuple[str, str, str, list[str]]:
    """The form of a name: exact part, level, kind and tokens of the core."""
    text = _reordered(_LATE_KEY.sub(r"\1", canonical_text(name).lower()))
    dotted: list[str] = []
    text = _ABBREVIATION.sub(lambda m: dotted.append(m[0].replace(".", "")) or f" {dotted[-1]} ", text)
    initials = {plain(t) for t in re.findall(r"(?<!\w)([^\W\d_])\.(?!\w)", text)}
    numbers: list[str] = []
    text = _NUMBER.sub(lambda m: numbers.append("/".join(re.findall(r"\d+", m[0]))) or " ", text)
    raw = re.findall(r"[^\W\d_]+", text)
    tokens = [plain(t) for t in raw]
    exact, level = [",".join(numbers)], ""
    if kind == "CHU_THE":
        relation = _starts(tokens, RELATIONS)
        if relation and len(tokens) > len(relation.split()) and (len(relation.split()) > 1 or _starts(tokens[1:], TITLES)):
            tokens = tokens[len(relation.split()) :]
            tokens = tokens[tokens[:1] == ["cua"] :]
            exact.append(relation)
        if tokens[:2] == ["chi", "nhanh"]:
            tokens = tokens[2 + (tokens[2:3] == ["so"]) :]
            exact.append("chi nhanh")
    head = _head(tokens) if kind in ("CHU_THE", "CO_QUAN", "VBPL") else None
    if head and head[0] == "decision" and kind == "VBPL":
        tokens = [t for t in tokens[head[2] :] if t not in ("so", "cua")]
        office = _head(tokens)
        tokens = tokens[office[2] :] if office and office[0] == "office" else tokens
        exact.append("qd")
        tokens, level = _place(tokens)
    elif head and head[0] == "office" and kind == "VBPL" and numbers:
        tokens = tokens[head[2] :]
        at = next((i for i in range(len(tokens)) if (h := _head(tokens[i:])) and h[0] == "decision"), len(tokens))
        exact.append("qd")
        tokens, level = _place([t for t in tokens[:at] if t not in ("so", "cua")])
    elif head and head[0] == "office" and kind == "CO_QUAN":
        exact.append(head[1])
        tokens, level = _place(tokens[head[2] :])
    elif head and head[0] == "company" and kind == "CHU_THE":
        exact.append(head[1])
        tokens = _without_sector(tokens[head[2] :])
    elif kind == "CHU_THE":
        return _person(exact, tokens, raw, dotted, initials)
    elif kind == "VBPL":
        tokens = [t for t in tokens if t != "so"]
    return "|".join([kind, *exact]), level, "full", tokens


def _place(tokens: list[str]) -> tuple[list[str], str]:
    """The name of a place and its level, if that is written."""
    named = _starts(tokens, LEVELS)
    if named and len(tokens) > len(named.split()):
        return tokens[len(named.split()) :], LEVELS[named]
    if len(tokens) > 1 and tokens[0] in LEVELS.values():
        return tokens[1:], tokens[0]
    return tokens, ""


def _without_sector(tokens: list[str]) -> list[str]:
    """A company's own name: the sector before or after it may be missing, shortened or misspelt."""
    best = tokens
    for n in range(1, min(4, len(tokens) - 2) + 1):
        for rest, part in ((tokens[n:], tokens[:n]), (tokens[:-n], tokens[-n:])):
            if len(rest) < len(best) and _is_sector("".join(part)):
                best = rest
    return best


@lru_cache(maxsize=200_000)
def _is_sector(word: str) -> bool:
    if deletions(word, 1).isdisjoint(_sector_forms()):  # no word within one edit
        return False
    return any(True for _ in _sectors().near(word, 0 if len(word) < 6 else 1))


@cache
def _sector_forms() -> frozenset[str]:
    return frozenset(form for sector in SECTORS for word in _shortened(sector) for form in deletions(word, 1))


@cache
def _sectors() -> Trie:
    trie = Trie()
    for sector in SECTORS:
        for word in _shortened(sector):
            trie.add(word, sector)
    return trie


def _person(exact: list[str], tokens: list[str], raw: list[str], dotted: list[str], initials: set[str]) -> tuple[str, str, str, list[str]]:
    title = _starts(tokens, TITLES)
    if title and not (title == "ba" and len(tokens) == 3):
        if len(tokens) - len(title.split()) >= 2:
            tokens = tokens[len(title.split()) :]
    if len(tokens) == 3 and tokens[0] in RANKS and not initials and not dotted:
        return "|".join(["CHU_THE", *exact]), tokens[0], "nick", tokens[1:]
    spread: list[str] = []
    for token in tokens:
        spread += list(token) if token in [plain(d) for d in dotted] and len(token) <= 3 else [token]
    if any(len(t) == 1 for t in spread) and len(spread) >= 3:
        return "|".join(["CHU_THE", *exact]), "", "initial", spread
    return "|".join(["CHU_THE", *exact]), "", "full", spread


#: Up to this many tokens a name is looked for in every order of them; longer names in the order in which they are written.
ORDERED = 8


def allowed(tokens: list[str]) -> int:
    """Edits between two spellings; of two names the smaller number counts. All pairs are found whose edits
    lie inside tokens, in any order of these, or of which one lost, gained or moved a space."""
    size = len(" ".join(tokens))
    return 0 if size < 5 else 1 if size < 16 or len(tokens) < 3 else 2


def deletions(token: str, most: int) -> set[str]:
    """The token without up to ``most`` of its letters. Two tokens within one edit share such a form with at most one letter less."""
    found = {token}
    for _ in range(most):
        found |= {t[:i] + t[i + 1 :] for t in found for i in range(len(t))}
    return found


def signatures(exact: str, kind: str, tokens: list[str]) -> Iterator[tuple[str, str, str]]:
    """(shard, rest, role): where a name meets every other within the bound, and what of it stands in the trie there.

    A shard is named by what must agree exactly: the exact part and all tokens but one, or two where two edits are allowed, in any
    order. The rest are the others; it is empty where all tokens agree, perhaps after two neighbours are run together. So two names with
    a number of edits always leave a shard in common. Initials are never edited. In shards with a role, full names
    meet abbreviations or nicknames: these agree in the initials and, within one letter, a whole token, or in one of two tokens.
    """
    most, n, key = allowed(tokens), len(tokens), f"{exact}#{kind}"
    name = lambda sort, parts: f"{key}#{sort}#{' '.join(parts)}"
    yield name("all", sorted(tokens)), "", ""
    if most and n <= ORDERED:
        for i in range(n - 1):
            yield name("all", sorted([*tokens[:i], tokens[i] + tokens[i + 1], *tokens[i + 2 :]])), "", ""
        whole = [i for i in range(n) if kind != "initial" or len(tokens[i]) > 1]
        if n == 1:
            for form in deletions(tokens[0], 1):
                yield name("one", [form]), tokens[0], ""
        else:
            for i in whole:
                yield name("but", sorted(tokens[:i] + tokens[i + 1 :])), tokens[i], ""
        for i, j in combinations(whole, 2) if most > 1 else ():
            yield name("but", sorted(t for at, t in enumerate(tokens) if at not in (i, j))), f"{tokens[i]} {tokens[j]}", ""
    elif most:
        # Five parts, of which two edits leave three as they are.
        parts = [tokens[n * i // 5 : n * (i + 1) // 5] for i in range(5)]
        for kept in combinations(range(5), 3):
            rest = " ".join(t for at, part in enumerate(parts) if at not in kept for t in part)
            yield name(f"{n}/{kept}", [t for at in kept for t in parts[at]]), rest, ""
    if exact.startswith("CHU_THE") and 3 <= n <= ORDERED or kind == "nick":
        letters = "".join(sorted(t[0] for t in tokens))
        if kind != "nick":
            for token in {t for t in tokens if len(t) > 1}:
                for form in deletions(token[1:], 1):
                    yield f"{exact}#short#{letters}#{token[0]}{form}", token, kind
        if kind != "initial":
            for first, second in {tuple(tokens[-2:]), tuple(tokens[-3:-1])} if kind == "full" else {tuple(tokens)}:
                yield f"{exact}#nick#{first}#", f"{first} {second}", kind
                yield f"{exact}#nick#-#{second}", f"{first} {second}", kind


def fit(short: list[str], full: list[str]) -> int | None:
    """How badly an abbreviation fits a full name: 2 an edit, 1 for an unusual order of its tokens; None if it does not fit. Every token
    stands for one of the full name: a letter for its first letter, a whole one for one with the same first letter, one edit in all."""
    if len(short) != len(full):
        return None
    for order in (full, full[1:] + full[:1], full[-1:] + full[:-1]):
        edits = [_token_edits(s, f) for s, f in zip(short, order)]
        if None not in edits and sum(edits) <= 1:
            return 2 * sum(edits)
    best = _assigned(sorted(short, key=len, reverse=True), full, 1)
    return None if best is None else 2 * best + 1


def _assigned(short: list[str], full: list[str], most: int) -> int | None:
    if not short:
        return 0
    best = None
    for i, token in enumerate(full):
        edits = _token_edits(short[0], token)
        if edits is not None and edits <= most:
            others = _assigned(short[1:], full[:i] + full[i + 1 :], most - edits)
            if others is not None and (best is None or edits + others < best):
                best = edits + others
    return best


def _token_edits(short: str, token: str) -> int | None:
    if short[0] != token[0]:
        return None
    if len(short) == 1 or short == token:
        return 0
    trie = Trie()
    trie.add(token, None)
    return min((edits for edits, _ in trie.near(short, 1)), default=None)


def with_form(names: DataFrame) -> DataFrame:
    """Adds ``form`` (exact, level, kind, tokens) to names (type, name); nulls are not allowed here."""

    @F.pandas_udf(FORM)
    def form(names: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_name(n, k) for n, k in zip(names, kinds)], columns=["exact", "level", "kind", "tokens"])

    return names.withColumn("form", form("name", "type"))


def in_shards(forms: DataFrame) -> DataFrame:
    """(shard, rest, role, id, level, bound, word): every form (id, exact, level, kind, tokens) in each of its shards. Shards are named by
    a digest of 128 bits; only abbreviations and the full names that meet them bear their word."""
    fields = forms.schema
    schema = T.StructType(
        [
            T.StructField("shard", T.BinaryType()),
            T.StructField("rest", T.StringType()),
            T.StructField("role", T.StringType()),
            T.StructField("id", fields["id"].dataType),
            T.StructField("level", T.StringType()),
            T.StructField("bound", T.IntegerType()),
            T.StructField("word", T.StringType()),
        ]
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for own, exact, level, kind, tokens in batch.itertuples(index=False, name=None):
                tokens = list(tokens)
                bound, word = allowed(tokens), " ".join(tokens)
                for shard, rest, role in signatures(exact, kind, tokens):
                    rows.append((xxhash.xxh128_digest(shard), rest, role, own, level, bound, word if role else None))
            yield pd.DataFrame(rows, columns=schema.names)

    return forms.select("id", "exact", "level", "kind", "tokens").mapInPandas(place, schema)


def near_forms(forms: DataFrame, most: int = 300) -> DataFrame:
    """Links (a, b, weak, cost) between forms (id, exact, level, kind, tokens) within the bound of ``allowed``; a weak link joins an
    abbreviation or nickname, ``a``, to a full name.

    Shards in which no two forms can meet are dropped by their counts. A shard of more than ``most`` forms is split by the tokens that
    are not in its name: forms whose rests are within the bound share a form of them with letters left out, so the split shards hold
    only forms that differ in a few letters, and nothing is copied to all. Where full names meet abbreviations, the full names are split
    by hash, and only the abbreviations stand in every part.
    """
    rows = cut_lineage(in_shards(forms))
    counts = cut_lineage(_counts(rows))
    links = _search_tries(rows.join(counts.where(~_hot(most)).select("shard"), "shard"))
    hot = counts.where(_hot(most)).select("shard", "n")
    if not hot.isEmpty():
        split = cut_lineage(_split(rows.join(hot, "shard"), most))
        links = links.unionByName(_search_tries(split.join(_counts(split).select("shard"), "shard")))
    return links.groupBy("a", "b", "weak").agg(F.min("cost").alias("cost"))


def _counts(rows: DataFrame) -> DataFrame:
    """The shards in which forms can meet, with the number of their forms: two of equal tokens, two of different rests, or two roles."""
    flag = lambda condition: F.max(condition.cast("int"))
    rest, equal, full = F.xxhash64("rest"), F.col("rest") == "", F.col("role") == "full"
    counts = rows.groupBy("shard").agg(
        F.count("*").alias("n"), F.min(rest).alias("_low"), F.max(rest).alias("_high"), flag(equal).alias("equal"), flag(full).alias("_full"), flag((F.col("role") != "") & ~full).alias("_short")
    )
    meeting = F.when((F.col("_full") > 0) | (F.col("_short") > 0), (F.col("_full") > 0) & (F.col("_short") > 0)).otherwise((F.col("_low") != F.col("_high")) | (F.col("equal") > 0))
    return counts.where(meeting & (F.col("n") > 1)).select("shard", "n", (F.col("equal") > 0).alias("equal"))


def _hot(most: int):
    return (F.col("n") > most) & ~F.col("equal")


def _split(rows: DataFrame, most: int) -> DataFrame:
    """Rows of hot shards in the shards that these are split into."""

    @F.pandas_udf("array<string>")
    def forms(rests: pd.Series, bounds: pd.Series) -> pd.Series:
        return pd.Series([sorted(rest_forms(r, k)) for r, k in zip(rests, bounds)])

    parts = F.ceil(F.col("n") / most).cast("long")
    salt = F.pmod(F.xxhash64("id"), parts).cast("string")
    blocks = F.when(F.col("role") == "full", F.array(salt)).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda i: i.cast("string")))
    strong = rows.where("role = ''").withColumn("_part", F.explode(forms("rest", "bound")))
    weak = rows.where("role != ''").withColumn("_part", F.explode(blocks))
    named = F.unhex(F.md5(F.concat(F.col("shard"), F.encode("_part", "utf-8"))))
    return strong.unionByName(weak).withColumn("shard", named).drop("_part", "n")


def rest_forms(rest: str, bound: int) -> set[str]:
    """The rest with letters left out of its tokens, one letter of two tokens each or up to ``bound`` of one; a rest of more tokens as it is."""
    tokens = rest.split(" ")
    if len(tokens) == 1:
        return deletions(rest, bound)
    if len(tokens) > 2:
        return {""}
    return {" ".join(sorted(pair)) for pair in product(*[deletions(t, 1) for t in tokens])}


def _search_tries(rows: DataFrame) -> DataFrame:
    id_type = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("weak", T.BooleanType()), T.StructField("cost", T.IntegerType())])
    columns = ["shard", "rest", "role", "id", "level", "bound", "word"]
    return rows.select(*columns).repartition("shard").sortWithinPartitions("shard", "rest").mapInPandas(_join_tries, schema)


def _join_tries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by shard: one trie is held at a time; shards of equal names are linked as they are read."""
    rows = (row for batch in batches for row in batch.itertuples(index=False, name=None))
    found: list[tuple] = []
    for (_, equal), group in groupby(rows, key=lambda r: (r[0], not r[1] and not r[2])):
        for link in _equal(group) if equal else _different(list(group)):
            found.append(link)
            if len(found) >= 20_000:
                yield pd.DataFrame(found, columns=["a", "b", "weak", "cost"])
                found = []
    yield pd.DataFrame(found, columns=["a", "b", "weak", "cost"])


def _equal(group: Iterator[tuple]) -> Iterator[tuple]:
    """All tokens agree: each form is linked to the first of its level, and a level that is not written to every other."""
    firsts: dict[str, object] = {}
    for row in group:
        level, own = row[4], row[3]
        if level in firsts:
            yield firsts[level], own, False, 0
            continue
        firsts[level] = own
        for other, first in firsts.items():
            if other != level and (not other or not level):
                yield first, own, False, 0


def _different(group: list[tuple]) -> Iterator[tuple]:
    return _meet_short(group) if group[0][2] else _meet(group)


def _meet(group: list[tuple]) -> Iterator[tuple]:
    """Forms whose rests lie within the bound, in any order of their tokens. Of forms with one rest, the first stands for all: the others
    meet it where all tokens agree."""
    firsts: dict[tuple[str, str], tuple] = {}
    for _, rest, _, own, level, bound, _ in group:
        tokens = rest.split(" ")
        key = (" ".join(sorted(tokens)) if len(tokens) == 2 else rest, level)
        if key not in firsts or own < firsts[key][0]:
            firsts[key] = (own, bound, level)
    trie = Trie()
    for (rest, _), value in firsts.items():
        trie.add(rest, value)
    for (rest, level), (own, bound, _) in firsts.items():
        tokens = rest.split(" ")
        for word in {rest, " ".join(tokens[::-1])} if len(tokens) == 2 else {rest}:
            for edits, (other, other_bound, other_level) in trie.near(word, bound):
                if own < other and edits <= other_bound and (level == other_level or not level or not other_level):
                    yield own, other, False, 0


def _meet_short(group: list[tuple]) -> Iterator[tuple]:
    """Abbreviations and nicknames with the full names that they fit."""
    trie, firsts = Trie(), {}
    for _, rest, role, own, _, _, word in group:
        if role == "full" and not (word, rest) in firsts:
            firsts[word, rest] = own
            trie.add(rest, (own, word))
    for _, rest, role, own, _, bound, word in group:
        if role != "full":
            for edits, (other, full) in trie.near(rest, 1 if role == "initial" else bound):
                cost = fit(word.split(" "), full.split(" ")) if role == "initial" else 2 * edits
                if cost is not None:
                    yield own, other, True, cost


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that links reach. Labels spread over the links until none changes; each round is written to the
    shared folder. Links (a, b) may point either way; nodes without links keep their own id."""
    both = cut_lineage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(nodes.select("id", F.col("id").alias("label")))
    while True:
        spread = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("_near"))
        updated = labels.join(spread, labels["id"] == spread["a"], "left").select("id", "label", F.least("label", F.coalesce("_near", "label")).alias("_new"))
        jumped = updated.join(updated.select(F.col("id").alias("_at"), F.col("_new").alias("_far")), F.col("_new") == F.col("_at"), "left")
        following = cut_lineage(jumped.select("id", "label", F.least("_new", F.coalesce("_far", "_new")).alias("_new")))
        changed = not following.where("_new != label").isEmpty()
        labels = following.select("id", F.col("_new").alias("label"))
        if not changed:
            return labels


def link_spellings(mentions: DataFrame, key: str, name: str, kind: str, types: tuple[str, ...] = ENTITY_TYPES) -> DataFrame:
    """One row per distinct (type, name) with a type of ``types`` and a non-null name: ``mention``, its smallest key, and ``bearer``, the
    smallest mention of all spellings of one bearer.

    Spellings are joined by ``near_forms``. An abbreviation or a nickname belongs to a bearer only if the full names that it fits best all
    belong to one bearer; else it stays alone. Rows with a null key, repeated rows and extra columns do no harm; names without letters or
    digits, the empty name among them, are each a bearer of their own.
    """
    rows = mentions.select(F.col(key).alias("mention"), F.col(name).alias("name"), F.col(kind).alias("type"))
    names = rows.where(F.col("name").isNotNull() & F.col("type").isin(*types) & F.col("mention").isNotNull()).groupBy("type", "name").agg(F.min("mention").alias("mention"))
    read = cut_lineage(with_form(names).select(F.col("mention").alias("id"), "form.*"))
    links = cut_lineage(near_forms(read.where((F.size("tokens") > 0) | F.col("exact").rlike(r"\d"))))
    strong = components(read.select("id"), links.where(~F.col("weak")))
    weak = links.where("weak").join(strong.select(F.col("id").alias("a"), F.col("label").alias("_short")), "a")
    weak = weak.join(strong.select(F.col("id").alias("b"), F.col("label").alias("_full")), "b")
    fits = weak.groupBy("_short", "cost").agg(F.min("_full").alias("_full"), F.max("_full").alias("_other"))
    best = fits.groupBy("_short").agg(F.min_by(F.struct("_full", "_other"), "cost").alias("_best"))
    sole = best.where("_best._full = _best._other").select("_short", F.col("_best._full").alias("_full"))
    named = strong.join(sole, strong["label"] == sole["_short"], "left").select(F.col("id").alias("mention"), F.coalesce("_full", "label").alias("_named"))
    return named.select("mention", F.col("_named").alias("bearer"))


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """Unordered pairs of mentions with one bearer, the smaller first."""
    left = linked.select("bearer", F.col("mention").alias("mention_a"))
    right = linked.select("bearer", F.col("mention").alias("mention_b"))
    return left.join(right, "bearer").where("mention_a < mention_b").select("mention_a", "mention_b")
