"""SQL that makes the chunks of both corpora a second way, to check the operators of ``operators/chunking.py`` against.

Every function gives the text of common table expressions, to stand behind WITH RECURSIVE.
"""

from __future__ import annotations

from tessera.functions.text import SECTION_LABELS, WHITE_SPACE
from tessera.operators.chunking import JUDGMENT_META, LEAST_CHARS, MAX_CHARS, MIN_CHARS, OVERLAP, SECTIONS, SEPARATORS, STATUTE_META

BLANK = "[\\s\\x{B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def literal(text: str) -> str:
    """A string literal; control characters are written by their codes."""
    parts, plain = [], ""
    for char in text:
        if ord(char) < 32:
            parts += [f"'{plain}'"] if plain else []
            parts.append(f"chr({ord(char)})")
            plain = ""
        else:
            plain += "''" if char == "'" else char
    return "(" + " || ".join([*parts, *([f"'{plain}'"] if plain or not parts else [])]) + ")"


_WHITE = literal(WHITE_SPACE)


def strip(text: str) -> str:
    return f"trim({text}, {_WHITE})"


def safe(column: str) -> str:
    return strip(f"coalesce(CAST({column} AS VARCHAR), '')")


def clean_lead(text: str) -> str:
    return strip(f"ltrim({text}, {literal(WHITE_SPACE + '.;,:')})")


def word_count(text: str) -> str:
    return f"CASE WHEN {strip(text)} = '' THEN 0 ELSE len(regexp_split_to_array({strip(text)}, '{BLANK}+')) END"


def path_parts(*columns: str) -> str:
    return "list_filter([" + ", ".join(safe(c) for c in columns) + "], lambda x: x <> '')"


def context_prefix(parts: str) -> str:
    """The prefix of a list column of parts."""
    kept = f"list_filter({parts}, lambda x, i: i = 1 OR x <> {parts}[i - 1])"
    return f"CASE WHEN len({parts}) = 0 THEN '' ELSE array_to_string({kept}, ' > ') || chr(10) END"


def section_prefix(case_type: str, title: str, subject: str, section: str) -> str:
    label = f"CASE {section} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SECTION_LABELS.items()) + f" ELSE {section} END"
    parts = [
        f"CASE WHEN {safe(case_type)} <> '' THEN '[' || {safe(case_type)} || ']' ELSE '' END",
        safe(title),
        f"CASE WHEN {safe(subject)} <> '' THEN '(' || {safe(subject)} || ')' ELSE '' END",
        f"'| Phần: ' || {label}",
    ]
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x <> ''), ' ') || chr(10)"


def splitter(name: str, source: str) -> str:
    """``{name}_pieces`` (k, pos, i, piece): the recursive pieces of the long texts of ``source`` (k, pos, txt).

    Texts are cut at the first separator that occurs, long parts again at the next; neighbouring short parts are joined by a fold whose
    window keeps the overlap.
    """
    chosen = "CASE " + " ".join(f"WHEN lvl <= {i} AND contains(txt, {literal(s)}) THEN {i}" for i, s in enumerate(SEPARATORS) if s) + f" ELSE {len(SEPARATORS) - 1} END"
    mark = "CASE sep " + " ".join(f"WHEN {i} THEN {literal(s)}" for i, s in enumerate(SEPARATORS) if s) + " END"
    size = "coalesce(list_sum(list_transform(acc.win, lambda w: length(w))), 0)"
    part = "x.win[1]"
    full = f"(len(acc.win) > 0 AND {size} + length({part}) > {MAX_CHARS})"
    rest = "coalesce(list_sum(list_transform(acc.win[i:], lambda w: length(w))), 0)"
    keep = f"list_min(list_filter(range(1, len(acc.win) + 2), lambda i: i = len(acc.win) + 1 OR ({rest} <= {OVERLAP} AND {rest} + length({part}) <= {MAX_CHARS})))"
    fold = f"""list_reduce(list_transform(parts, lambda p: {{'done': []::VARCHAR[], 'win': [p]}}), lambda acc, x: CASE WHEN {full}
        THEN {{'done': list_append(acc.done, {strip("array_to_string(acc.win, '')")}), 'win': list_append(acc.win[{keep}:], {part})}}
        ELSE {{'done': acc.done, 'win': list_append(acc.win, {part})}} END, {{'done': []::VARCHAR[], 'win': []::VARCHAR[]}})"""
    return f"""{name}_nodes AS (
      SELECT k, pos, []::INTEGER[] AS route, txt, 0 AS lvl FROM {source}
      UNION ALL
      SELECT k, pos, list_append(route, CAST(j AS INTEGER)), parts[j], sep + 1 FROM (
        SELECT *, unnest(generate_series(1, len(parts))) AS j FROM (
          SELECT k, pos, route, sep, list_filter(CASE WHEN sep = {len(SEPARATORS) - 1} THEN regexp_extract_all(txt, '(?s).')
            ELSE list_transform(string_split(txt, {mark}), lambda p, n: CASE WHEN n = 1 THEN p ELSE ({mark}) || p END) END, lambda p: p <> '') AS parts
          FROM (SELECT *, {chosen} AS sep FROM {name}_nodes WHERE length(txt) > {MAX_CHARS} AND lvl < {len(SEPARATORS)})))
    ), {name}_ranked AS (
      SELECT *, route[:len(route) - 1] AS parent, sum(CAST(length(txt) > {MAX_CHARS} AS INTEGER)) OVER (PARTITION BY k, pos, route[:len(route) - 1] ORDER BY route[len(route)]) AS run
      FROM {name}_nodes WHERE len(route) > 0
    ), {name}_runs AS (
      SELECT k, pos, min(route) AS route, list(txt ORDER BY route) AS parts FROM {name}_ranked WHERE length(txt) <= {MAX_CHARS} GROUP BY k, pos, parent, run
    ), {name}_folded AS (SELECT k, pos, route, {fold} AS f FROM {name}_runs
    ), {name}_lists AS (SELECT k, pos, route, list_filter(list_append(f.done, {strip("array_to_string(f.win, '')")}), lambda p: p <> '') AS pieces FROM {name}_folded
    ), {name}_pieces AS (
      SELECT k, pos, row_number() OVER (PARTITION BY k, pos ORDER BY route, n) AS i, piece FROM (
        SELECT k, pos, route, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS n FROM {name}_lists))"""


def _merged(pieces: str, name: str, source: str, keys: str) -> str:
    """``{name}``: ``keys`` and the list ``m`` of the list column ``pieces`` of ``source``, short entries merged forward."""
    text = "(CASE WHEN a.carry = '' THEN x.done[1] ELSE a.carry || chr(10) || x.done[1] END)"
    fold = f"""list_reduce(list_transform({pieces}, lambda p: {{'done': [p], 'carry': ''}}), lambda a, x: CASE WHEN length({text}) < {MIN_CHARS}
        THEN {{'done': a.done, 'carry': {text}}} ELSE {{'done': list_append(a.done, {text}), 'carry': ''}} END, {{'done': []::VARCHAR[], 'carry': ''}})"""
    return f"""{name} AS (
      SELECT {keys}, CASE WHEN len({pieces}) <= 1 THEN {pieces} WHEN f.carry = '' THEN f.done WHEN len(f.done) = 0 THEN [f.carry]
        ELSE list_append(f.done[:len(f.done) - 1], f.done[len(f.done)] || chr(10) || f.carry) END AS m
      FROM (SELECT *, {fold} AS f FROM {source}))"""


def clause_ctes(source: str) -> str:
    """``st_rows`` (k, t and the other columns of ``source``), ``st_clauses`` (k, c) and ``st_merged`` (k, m)."""
    marked = f"string_split(regexp_replace(t, '(?m)^([1-9]\\p{{Nd}}?\\.{BLANK}+[^\\n]{{15}})', chr(1) || '\\1', 'g'), chr(1))"
    lead = f"array_to_string(list_filter([{strip('p[1]')}, {strip('p[2]')}], lambda x: x <> ''), chr(10))"
    stripped = lambda part: f"list_transform({part}, lambda x: {strip('x')})"
    return f"""st_rows AS (SELECT row_number() OVER () AS k, {safe('content_text')} AS t, * FROM {source}),
    st_clauses AS (
      SELECT k, CASE WHEN t = '' THEN []::VARCHAR[] WHEN len(p) < 2 THEN {stripped('p')} WHEN p[1] = '' THEN {stripped('p[2:]')}
        ELSE list_concat([{lead}], {stripped('p[3:]')}) END AS c
      FROM (SELECT k, t, {marked} AS p FROM st_rows)
    ), {_merged('c', 'st_merged', 'st_clauses', 'k')}"""


def statute_ctes(source: str) -> str:
    """``made_statutes``: the 18 columns of statute chunks of a table of articles."""
    meta = ", ".join(f"{safe('s.' + c)} AS {c}" for c in STATUTE_META)
    head = f"regexp_extract(txt, '^(\\p{{Nd}}+\\.{BLANK}+)', 1)"
    kept = f"list_filter(list(piece ORDER BY i), lambda p: length(p) >= {LEAST_CHARS})"
    return f"""{clause_ctes(source)},
    st_pieces AS (SELECT k, pos, m[pos] AS txt, len(m) AS n FROM (SELECT k, m, unnest(generate_series(1, len(m))) AS pos FROM st_merged JOIN st_rows USING (k) WHERE t NOT IN ('', 'nan'))),
    st_long AS (SELECT k, pos, txt FROM st_pieces WHERE length(txt) > {MAX_CHARS}),
    {splitter('sl', 'st_long')},
    st_kept AS (SELECT k, pos, {kept} AS kept FROM (SELECT k, pos, i, {clean_lead('piece')} AS piece FROM sl_pieces) GROUP BY k, pos),
    st_cut AS (
      SELECT k, pos, unnest(generate_series(1, len(kept))) AS i, kept, txt FROM (SELECT k, pos, txt, CASE WHEN len(kept) = 0 THEN [txt] ELSE kept END AS kept FROM st_kept JOIN st_long USING (k, pos))
    ), st_chunks AS (
      SELECT k, pos, 0 AS i, txt AS chunk_text, CASE WHEN n > 1 THEN 'khoan' ELSE 'full' END AS chunk_type FROM st_pieces WHERE length(txt) <= {MAX_CHARS}
      UNION ALL
      SELECT k, pos, i, CASE WHEN i = 1 OR {head} = '' THEN kept[i] ELSE '[...' || {strip(head)} || '] ' || kept[i] END, 'split' FROM st_cut
    ), st_placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos, i) - 1 AS chunk_index, count(*) OVER (PARTITION BY k) AS chunk_total FROM st_chunks),
    st_meta AS (SELECT k, {meta}, {path_parts('s.topic_title_vi', 's.subject_title_vi', 's.chapter_title', 's.article_title')} AS parts FROM st_rows s),
    made_statutes AS (
      SELECT doc_id || '::' || article_id || '::chunk::' || chunk_index AS chunk_id, chunk_index, chunk_total, chunk_type, chunk_text,
        {context_prefix('parts')} || chunk_text AS embed_text, length(chunk_text) AS chunk_char_len, {word_count('chunk_text')} AS chunk_word_count, {', '.join(STATUTE_META)}
      FROM st_placed JOIN st_meta USING (k))"""


def judgment_ctes(source: str) -> str:
    """``made_judgments``: the 22 columns of judgment chunks of a table of judgments with one row per doc_id, their sentences taken out of
    their texts; ``jd_sentences`` has these."""
    kinds = "['header', 'case_summary', 'findings', 'decision', 'footer']"
    numbers = ("year", "applied_article_number")
    meta = ", ".join((f"coalesce(CAST({c} AS BIGINT), 0)" if c in numbers else safe(c)) + f" AS {c}" for c in JUDGMENT_META)
    piece = "{'text': %s, 'section': %s}"
    empty = "[]::STRUCT(text VARCHAR, section VARCHAR)[]"
    joins = f"(x.section = a.section AND a.n + length(x.text) + 1 <= {MAX_CHARS})"
    flushed = f"(CASE WHEN a.some THEN list_append(a.done, {piece % ('a.text', 'a.section')}) ELSE a.done END)"
    packed = f"""list_reduce(list_transform(kept, lambda p: {{'done': {empty}, 'text': p.text, 'section': p.section, 'n': length(p.text), 'some': true}}),
        lambda a, x: {{'done': CASE WHEN {joins} THEN a.done ELSE {flushed} END,
          'text': CASE WHEN {joins} AND a.some THEN a.text || chr(10) || x.text ELSE x.text END, 'section': x.section,
          'n': CASE WHEN {joins} THEN a.n + length(x.text) + 1 ELSE length(x.text) END, 'some': true}},
        {{'done': {empty}, 'text': '', 'section': first_section, 'n': 0::BIGINT, 'some': false}})"""
    text = "(CASE WHEN a.carry = '' THEN x.done[1].text ELSE a.carry || chr(10) || x.done[1].text END)"
    merged = f"""list_reduce(list_transform(p, lambda q: {{'done': [q], 'carry': '', 'section': ''}}), lambda a, x: CASE WHEN length({text}) < {MIN_CHARS}
        THEN {{'done': a.done, 'carry': {text}, 'section': x.done[1].section}}
        ELSE {{'done': list_append(a.done, {piece % (text, 'x.done[1].section')}), 'carry': '', 'section': x.done[1].section}} END, {{'done': {empty}, 'carry': '', 'section': ''}})"""
    back = piece % ("f.done[len(f.done)].text || chr(10) || f.carry", "f.done[len(f.done)].section")
    return f"""jd_one AS (SELECT doc_id, min(content_markdown) AS t FROM {source} WHERE doc_id IS NOT NULL AND content_markdown <> '' GROUP BY 1),
    jd_parts AS (
      SELECT doc_id, CAST(regexp_matches(t, '^##\\s') AS INTEGER) AS headed, string_split(regexp_replace(t, '(\\r\\n|[\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}])(##\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts
      FROM jd_one
    ), jd_lines AS (
      SELECT doc_id, section, unnest(lines) AS line_text, generate_subscripts(lines, 1) - 1 AS line FROM (
        SELECT doc_id, j - 1 + headed AS section, regexp_split_to_array(parts[j], '\\r\\n|[\\r\\n]') AS lines FROM (SELECT *, unnest(generate_series(1, len(parts))) AS j FROM jd_parts))
    ), jd_split AS (
      SELECT doc_id, section, line, string_split(regexp_replace({strip('line_text')}, '([.!?])[\\s\\x{{B}}]+', '\\1' || chr(1), 'g'), chr(1)) AS s
      FROM jd_lines WHERE NOT regexp_matches(line_text, '^#') AND {strip('line_text')} <> ''
    ), jd_sentences AS (
      SELECT doc_id AS doc_name, 'p.' || section || '.' || line AS paragraph_id, {kinds}[least(section + 1, 5)] AS section_kind, j - 1 AS index_in_paragraph,
        (CAST(section AS BIGINT) * 1000000 + line) * 100000 + j - 1 AS global_index, s[j] AS text
      FROM (SELECT *, unnest(generate_series(1, len(s))) AS j FROM jd_split)
    ), jd_paragraphs AS (
      SELECT doc_name, min(global_index) AS pos, section_kind AS section, {clean_lead("string_agg(text, ' ' ORDER BY index_in_paragraph, global_index, text)")} AS text
      FROM jd_sentences GROUP BY doc_name, paragraph_id, section_kind
    ), jd_found AS (
      SELECT doc_name, arg_min(section, pos) AS first_section, coalesce(list({piece % ('text', 'section')} ORDER BY pos) FILTER (WHERE section IN ({', '.join(f"'{s}'" for s in SECTIONS)})), {empty}) AS kept
      FROM jd_paragraphs WHERE text <> '' GROUP BY doc_name
    ), jd_packed AS (SELECT doc_name, {flushed.replace('a.', 'f.')} AS p FROM (SELECT doc_name, {packed} AS f FROM jd_found)
    ), jd_merged AS (
      SELECT doc_name AS k, CASE WHEN len(p) <= 1 THEN p WHEN f.carry = '' THEN f.done WHEN len(f.done) = 0 THEN [{piece % ('f.carry', 'f.section')}]
        ELSE list_append(f.done[:len(f.done) - 1], {back}) END AS m
      FROM (SELECT doc_name, p, {merged} AS f FROM jd_packed)
    ), jd_pieces AS (SELECT k, pos, m[pos].text AS txt, m[pos].section AS section, len(list_filter(m, lambda q: length(q.text) > {MAX_CHARS})) > 0 AS cut FROM (SELECT k, m, unnest(generate_series(1, len(m))) AS pos FROM jd_merged)
    ), jd_long AS (SELECT k, pos, txt FROM jd_pieces WHERE length(txt) > {MAX_CHARS}),
    {splitter('jl', 'jd_long')},
    jd_all AS (
      SELECT k, pos, 0 AS i, CASE WHEN cut THEN {clean_lead('txt')} ELSE txt END AS text, section, cut FROM jd_pieces WHERE length(txt) <= {MAX_CHARS}
      UNION ALL
      SELECT p.k, p.pos, l.i, {clean_lead('l.piece')}, section, cut FROM jd_pieces p JOIN jl_pieces l ON p.k = l.k AND p.pos = l.pos
    ), jd_own AS (SELECT k, text, section AS kind, row_number() OVER (PARTITION BY k ORDER BY pos, i) - 1 AS ord FROM jd_all WHERE NOT cut OR length(text) >= {LEAST_CHARS}
    ), jd_meta AS (SELECT {meta}, {safe('principle_text')} AS principle FROM {source}
    ), jd_chunks AS (
      SELECT k, text, kind, ord, CAST(ord AS VARCHAR) AS name FROM jd_own
      UNION ALL SELECT doc_id, principle, 'principle', -1, 'principle' FROM jd_meta WHERE principle <> '' AND doc_id IN (SELECT k FROM jd_own)
    ), jd_placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) - 1 AS chunk_index, count(*) OVER (PARTITION BY k) AS chunk_total FROM jd_chunks
    ), made_judgments AS (
      SELECT k || '::chunk::' || name AS chunk_id, chunk_index, chunk_total, kind AS chunk_type, text AS chunk_text,
        CASE WHEN kind = 'principle' THEN '[Nguyên tắc pháp lý] ' ELSE '' END || {section_prefix('case_type', 'title', 'subject', 'kind')} || text AS embed_text,
        length(text) AS chunk_char_len, {word_count('text')} AS chunk_word_count, {', '.join(JUDGMENT_META)}
      FROM jd_placed JOIN jd_meta ON k = doc_id)"""


#: The judgments with one row per doc_id, the one of smallest text columns; repeats are copies.
ONE_JUDGMENT = "one_judgment AS (SELECT DISTINCT * FROM anle_unified WHERE doc_id IS NOT NULL)"

STATUTE_CHUNKS = f"WITH RECURSIVE {statute_ctes('phapdien_unified')} SELECT * FROM made_statutes"
STATUTE_CLAUSES = f"WITH {clause_ctes('phapdien_unified')} SELECT doc_id, len(c) AS n_clauses, len(m) AS n_merged FROM st_clauses JOIN st_merged USING (k) JOIN st_rows USING (k)"
JUDGMENT_CHUNKS = f"WITH RECURSIVE {ONE_JUDGMENT}, {judgment_ctes('one_judgment')} SELECT * FROM made_judgments"
