"""SQL forms of the queries, for an engine with RE2 expressions and list lambdas."""

from __future__ import annotations

from glyphmill.functions import fixed as K

W = r"[\t-\r\x{85}\pZ]"
N = r"[^\pL\pN_]"
RUN = r"[\pL\pN_]"


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def items(words) -> str:
    return "(" + ", ".join(s(w) for w in words) + ")"


GLOSSARY = (
    "g AS (SELECT CASE WHEN b.ord IS NOT NULL THEN b.ord ELSE 1000 + t.ord END AS ord, coalesce(t.wrong, b.wrong) AS wrong, coalesce(t.canon, b.canon) AS canon FROM (VALUES "
    + ", ".join(f"({i}, {s(w)}, {s(c)})" for i, (w, c) in enumerate(K.GLOSSARY.items(), 1))
    + ") b(ord, wrong, canon) FULL JOIN (SELECT ord, lower(wrong) AS wrong, canon FROM glossary) t ON b.wrong = t.wrong)"
)
E = (
    "WITH l AS (SELECT list(code) AS codes FROM languages), "
    "e AS (SELECT entry_id, file, line, key, value AS v, coalesce(list_filter(string_split_regex(regexp_replace(lower(file), '\\.js$', ''), '[_.\\-]'), lambda x: list_contains(codes, x))[1], 'unknown') AS lang_code "
    "FROM parse_entries, l WHERE value IS NOT NULL)"
)
ENGLISH = "lang_code IN ('en', 'unknown')"
WORDS = f"list_filter(string_split_regex(v, '{W}+'), lambda x: x <> '')"
SENTENCE = f"(len({WORDS}) >= 3 OR regexp_matches(regexp_replace(v, '{W}+$', ''), '[.!?:]$'))"


def unnested(issues: str, where: str = "true") -> str:
    return f"{E} SELECT entry_id, CAST(i - 1 AS INTEGER) AS issue_no, issues[i] AS issue FROM (SELECT entry_id, {issues} AS issues FROM e WHERE {where}) q, unnest(range(1, len(issues) + 1)) t(i)"


def simple(condition: str, message: str, where: str = "true") -> str:
    return f"{E} SELECT entry_id, CAST(0 AS INTEGER) AS issue_no, {s(message)} AS issue FROM e WHERE {where} AND {condition}"


def matches(pattern: str) -> str:
    return f"regexp_matches(v, {s(pattern)})"


def changed(after: str) -> str:
    return f"{E} SELECT entry_id, after FROM (SELECT entry_id, v, {after} AS after FROM e) q WHERE after <> v"


def replaced(pattern: str, by: str, flags: str = "g") -> str:
    return f"regexp_replace(v, {s(pattern)}, {s(by)}, {s(flags)})"


def rebuilt(pattern: str, change: str) -> str:
    """Every match t of the pattern replaced by an expression of it."""
    return (
        f"array_to_string(list_transform(range(1, len(string_split_regex(v, {s(pattern)})) + 1), lambda i: string_split_regex(v, {s(pattern)})[i] || "
        f"coalesce(list_transform(regexp_extract_all(v, {s(pattern)}), lambda t: {change})[i], '')), '')"
    )


AUX = K.AUXILIARIES
START = f"(?:^|[.!?]{W}+)[A-Za-z][A-Za-z0-9'']*".replace("''", "'")
START_WORD = "regexp_extract(t, '[A-Za-z][A-Za-z0-9'']*$')"
BAD_START = f"(regexp_matches({START_WORD}, '^[a-z]') AND (NOT regexp_matches(t, '^[A-Za-z]') OR {SENTENCE}))"
COMMA_WORD = f",{W}+([A-Z]{RUN}*)"
COMMA_LIST = f"list_filter(regexp_extract_all(v, {s(COMMA_WORD)}, 1), lambda x: regexp_full_match(x, '[A-Z][a-z]+') AND lower(x) IN {items(K.CONTINUATIONS)})"
REPEATED = (
    f"list_filter(list_transform(range(1, len({WORDS})), lambda i: struct_pack(a := {WORDS}[i], b := {WORDS}[i + 1])), "
    "lambda p: NOT contains(p.a, '[') AND NOT contains(p.b, '[') AND length(regexp_replace(p.a, '[^A-Za-z]', '', 'g')) > 2 AND lower(regexp_replace(p.a, '[^A-Za-z]', '', 'g')) = lower(regexp_replace(p.b, '[^A-Za-z]', '', 'g')))"
)
REPEATED_TEXT = f"list_transform({REPEATED}, lambda p: 'Repeated word: \"' || p.a || ' ' || p.b || '\"')"
PASSIVE = f"(?i)(?:^|{N})((?:been|being){W}+handovers?)(?:{N}|$)"
IDS = f"list_filter(regexp_extract_all(v, '{RUN}+'), lambda x: regexp_full_match(x, '[A-Za-z]*[a-z]ID'))"
LEXICON = (
    "lex AS (SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(v), '[a-z'']+')) AS word FROM e WHERE "
    + ENGLISH
    + ") q WHERE length(word) >= 2 GROUP BY word HAVING count(*) >= 5)"
)
TOKENS = (
    "tok AS (SELECT word, count(*) AS n FROM (SELECT regexp_replace(unnest(regexp_extract_all(regexp_replace(regexp_replace(v, '\\[[^\\]]*\\]', '#', 'g'), '[A-Za-z]+[\"‘’“”][A-Za-z]+', '#', 'g'), '[A-Za-z'']+')), '^''+|''+$', '', 'g') AS word FROM e WHERE "
    + ENGLISH
    + ") q WHERE length(word) >= 3 AND NOT (word = upper(word) AND word <> lower(word)) AND NOT regexp_full_match(word, '[A-Za-z]*[a-z]ID') GROUP BY word)"
)
OOV = f"{E}, {LEXICON}, {TOKENS}, oov AS (SELECT word, lower(word) AS low FROM tok WHERE lower(word) NOT IN (SELECT word FROM lex))"
CUSTOM = "custom AS (SELECT DISTINCT lower(trim(canon)) AS word FROM glossary WHERE trim(canon) <> '' AND canon NOT LIKE '#%')"
PREFIX_ROWS = " UNION ALL ".join(f"SELECT word, substr(low, {len(p) + 1}) AS form FROM oov WHERE starts_with(low, {s(p)}) AND length(low) >= {len(p) + 3}" for p in K.PREFIXES)
REGION_ROWS = " UNION ALL ".join(
    f"SELECT word, left(low, length(low) - {len(x)}) || {s(y)} AS form FROM oov WHERE ends_with(low, {s(x)})" for a, b in K.SUFFIX_PAIRS for x, y in ((a, b), (b, a))
)
LINE = r'^(\s*)languageResource\.([A-Za-z0-9_]+)\s*=\s*"((?:[^"\\]|\\.)*)"(\s*;)?(\s*(?://.*)?)\r?$'


def part(i: int) -> str:
    return f"regexp_extract(raw, {s(LINE)}, {i})"


#: Glossary pairs as lists, custom words, and phrases as one alternation, for rules that look at every pair.
LISTS = (
    f"{GLOSSARY}, {CUSTOM}, gl AS (SELECT list(DISTINCT x) AS terms FROM (SELECT wrong AS x FROM g WHERE NOT contains(wrong, ' ') UNION SELECT lower(canon) FROM g WHERE NOT contains(wrong, ' ') UNION SELECT word FROM custom) q), "
    "ph AS (SELECT coalesce('(?i)(?:' || string_agg(regexp_escape(wrong), '|' ORDER BY length(wrong) DESC, ord) || ')', '[^\\s\\S]') AS phrases FROM g WHERE contains(wrong, ' '))"
)


def placed(text: str, pattern: str) -> str:
    """Matches of a pattern with their places, from 1: what lies between them is measured."""
    found, between = f"regexp_extract_all({text}, {pattern})", f"string_split_regex({text}, {pattern})"
    before = f"list_sum(list_transform({between}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({found}[1:i - 1], lambda x: length(x))), 0)"
    return f"list_transform(range(1, len({found}) + 1), lambda i: struct_pack(t := {found}[i], at := 1 + {before}))"


def word_at(text: str, at: str) -> str:
    return f"regexp_full_match(substr({text}, {at}, 1), '{RUN}')"


ACTION_WORDS = f"'(?i)(?:click|tap|press|select|choose|hit){W}+(?:on{W}+|the{W}+)?[A-Za-z][A-Za-z/-]*'"
MINOR = items(("of", "the", "a", "an", "in", "to", "and", "or", "is", "are", "was", "were", "by", "on", "at", "as", "per", "vs", "nor", "but", "for"))


def casing_steps(name: str, source: str, text: str) -> str:
    """Tables ``name_w``, with words and protected stretches, and ``name``, with words and whether each is free to change or vote."""
    lone = "regexp_full_match(r[i].t, '[A-Za-z]+')"
    near = f"(i > 1 AND regexp_full_match(r[i - 1].t, '[A-Za-z]+') AND substr({text}, CAST(r[i - 1].at + length(r[i - 1].t) AS BIGINT), CAST(r[i].at - r[i - 1].at - length(r[i - 1].t) AS BIGINT)) IN ('-', '/'))"
    after = f"(i < len(r) AND regexp_full_match(r[i + 1].t, '[A-Za-z]+') AND substr({text}, CAST(r[i].at + length(r[i].t) AS BIGINT), CAST(r[i + 1].at - r[i].at - length(r[i].t) AS BIGINT)) IN ('-', '/'))"
    target = "regexp_extract(x.t, '[A-Za-z][A-Za-z/-]*$')"
    return (
        f"{name}_r AS (SELECT *, {placed(text, chr(39) + RUN + '+' + chr(39))} AS r, {placed(text, chr(39) + chr(91) + 'A-Za-z' + chr(39) * 2 + chr(93) + '+' + chr(39))} AS w, "
        f"{placed(text, 'phrases')} AS p, {placed(text, ACTION_WORDS)} AS a FROM {source}, gl, ph), "
        f"{name}_w AS (SELECT *, list_transform(list_filter(range(1, len(r) + 1), lambda i: {lone} AND ({near} OR {after})), lambda i: struct_pack(lo := r[i].at, hi := r[i].at + length(r[i].t))) "
        f"|| list_transform(list_filter(p, lambda x: NOT {word_at(text, 'CAST(x.at - 1 AS BIGINT)')} AND NOT {word_at(text, 'CAST(x.at + length(x.t) AS BIGINT)')}), lambda x: struct_pack(lo := x.at, hi := x.at + length(x.t))) "
        f"|| list_transform(list_filter(a, lambda x: (x.at = 1 OR NOT {word_at(text, 'CAST(x.at - 1 AS BIGINT)')}) AND NOT {word_at(text, 'CAST(x.at + length(x.t) AS BIGINT)')}), lambda x: struct_pack(lo := x.at + length(x.t) - length({target}), hi := x.at + length(x.t))) AS held FROM {name}_r), "
        f"{name} AS (SELECT *, list_transform(w, lambda x: struct_pack(t := x.t, at := x.at, content := length(x.t) > 1 AND lower(x.t) NOT IN {MINOR}, "
        "free := NOT (x.t = upper(x.t) AND x.t <> lower(x.t)) AND NOT list_contains(terms, lower(x.t)) AND len(list_filter(held, lambda h: h.lo <= x.at AND x.at < h.hi)) = 0, "
        f"titled := regexp_matches(x.t, '^[A-Z]') AND NOT (x.t = upper(x.t) AND x.t <> lower(x.t)), low := regexp_matches(x.t, '^[a-z]'))) AS tok FROM {name}_w)"
    )


#: Votes on casing: words after the first content word that are free, in values of one sentence.
VOTES = (
    f"{LISTS}, c0 AS (SELECT entry_id, lang_code, v, regexp_replace(v, '(^|{N})No\\.{W}*', '\\1', 'g') AS plain FROM e), {casing_steps('c1', 'c0', 'plain')}, "
    "c2 AS (SELECT entry_id, lang_code, v, list_filter(tok, lambda x: x.content) AS content FROM c1), "
    f"votes AS (SELECT entry_id, lang_code, v, list_filter(content[2:], lambda x: x.free) AS vote, len(content) >= 3 AND NOT regexp_matches(v, '[.!?]{W}+[A-Z]') AS able FROM c2), "
    "kinds AS (SELECT entry_id, lang_code, v, CASE WHEN able AND len(list_filter(vote, lambda x: x.titled)) > 0 THEN CASE WHEN len(list_filter(vote, lambda x: x.low)) > 0 THEN 'mixed' ELSE 'title' END END AS kind FROM votes)"
)
RECASED = (
    f"{VOTES}, k1 AS (SELECT entry_id, v FROM kinds WHERE kind IS NOT NULL), {casing_steps('k2', 'k1', 'v')}, "
    "k3 AS (SELECT entry_id, v, tok, coalesce(list_min(list_transform(list_filter(tok, lambda x: x.content), lambda x: x.at)), 0) AS head FROM k2), "
    "k4 AS (SELECT entry_id, v, list_transform(tok, lambda x: CASE WHEN x.content AND x.at > head AND x.free AND x.titled THEN lower(left(x.t, 1)) || substr(x.t, 2) ELSE x.t END) AS new, string_split_regex(v, '[A-Za-z'']+') AS gaps FROM k3)"
)

SQL: dict[str, str] = {
    "s1_lines": "SELECT file, count(*) AS n_lines, max(line) AS last_line FROM resource_lines GROUP BY file",
    "s2_parse_entries": f"SELECT file, line, {part(2)} AS key, {part(3)} AS value FROM resource_lines WHERE regexp_matches(raw, {s(LINE)})",
    "s2_line_parts": f"SELECT file, line, CAST(length({part(1)}) AS INTEGER) AS indent, {part(2)} AS key, trim({part(4)}) AS semi, trim({part(5)}) AS trail FROM resource_lines WHERE regexp_matches(raw, {s(LINE)})",
    "s4_glossary": f"WITH {GLOSSARY} SELECT CAST(row_number() OVER (ORDER BY ord) AS INTEGER) AS ord, wrong, canon FROM g",
    "s5_custom_words": f"WITH {CUSTOM} SELECT word FROM custom",
    "s7_fuzzy_words": f"WITH {CUSTOM} SELECT word FROM custom WHERE length(word) >= 4",
    "s8_mixed_case_words": "SELECT DISTINCT trim(canon) AS word FROM glossary WHERE canon <> lower(canon) AND canon <> upper(canon)",
    "s10_detect_language": "WITH l AS (SELECT list(code) AS codes FROM languages), f AS (SELECT file, list_filter(string_split_regex(regexp_replace(lower(file), '\\.js$', ''), '[_.\\-]'), lambda x: list_contains(codes, x))[1] AS code FROM resource_files, l) "
    "SELECT file, coalesce(f.code, 'unknown') AS lang_code, coalesce(name, 'Unknown') AS lang_name, CASE WHEN f.code IS NULL THEN 'unknown' ELSE 'filename' END AS detection FROM f LEFT JOIN languages ON f.code = languages.code",
    "s11_language_override": "SELECT file, 'sv' AS lang_code, 'sv' AS lang_name, 'manual' AS detection FROM resource_files",
    "s12_lexicon_languages": "SELECT lang_code, count(*) AS n_files FROM resource_files WHERE lang_code IN (SELECT code FROM languages WHERE has_speller) GROUP BY lang_code",
    "k9_output_names": "SELECT file, regexp_replace(file, '\\.[^.]*$', '') || '.FIXED.js' AS fixed, regexp_replace(file, '\\.[^.]*$', '') || '.diff_report.csv' AS report, regexp_replace(file, '\\.[^.]*$', '') || '.duplicates.csv' AS duplicates, regexp_replace(file, '\\.[^.]*$', '') || '.qa_report.xlsx' AS workbook FROM resource_files",
    "u1_skip_words": f"WITH {CUSTOM}, {GLOSSARY} SELECT word FROM custom UNION SELECT wrong FROM g",
    "d01_trim": simple(f"v <> regexp_replace(v, '^{W}+|{W}+$', '', 'g')", K.M_TRIM),
    "d02_double_space": simple("contains(v, '  ')", K.M_DOUBLE_SPACE),
    "d03_missing_space": simple(f"len(list_filter(regexp_extract_all(v, '[.,!?;:]([A-Za-z]{RUN}*)', 1), lambda x: x NOT IN {items(K.EXTENSIONS)})) > 0", K.M_MISSING_SPACE),
    "d04_space_before_stop": simple(matches(f"{W}[,.]"), K.M_SPACE_BEFORE),
    "d05_space_before_mark": simple(matches(f"{W}[!?;:]"), K.M_SPACE_BEFORE, "lang_code <> 'fr'"),
    "d06_french_space": simple(matches("[A-Za-z][!?;:]"), K.M_FRENCH, "lang_code = 'fr'"),
    "d07_repeated_mark": simple("(contains(v, '!!') OR contains(v, '??'))", K.M_REPEATED),
    "d08_double_period": simple("len(list_filter(regexp_extract_all(v, '\\.+'), lambda x: length(x) = 2)) > 0", K.M_DOUBLE_PERIOD),
    "d09_no_of_glued": simple(matches(f"No\\.Of(?:{N}|$)"), K.M_NO_OF_GLUED, ENGLISH),
    "d10_no_of_case": simple(f"{matches(f'No[.]{W}*Of(?:{N}|$)')} AND NOT {matches(f'No[.]Of(?:{N}|$)')}", K.M_NO_OF, ENGLISH),
    "d11_comma_splice": simple(matches(f",{W}+(?:{AUX})(?:[^.!?\\pL\\pN_][^.!?]*)?\\?"), K.M_SPLICE, ENGLISH),
    "d12_fail_to": simple(matches(f"(?:^|[.!?]{W}+)[Ff]ail{W}+to(?:{N}|$)"), K.M_FAIL, ENGLISH),
    "d13_sentence_case": unnested(f"list_transform(list_filter(regexp_extract_all(v, {s(START)}), lambda t: {BAD_START}), lambda t: {s(K.M_START)})", ENGLISH),
    "d14_comma_case": unnested(f"list_transform({COMMA_LIST}, lambda x: '\"' || x || '\" should be lowercase after a mid-sentence comma: \"...,  ' || lower(x) || '...\"')", ENGLISH),
    "d15_mixed_case": f"{E}, {VOTES} SELECT entry_id, CAST(0 AS INTEGER) AS issue_no, 'Inconsistent capitalization - mixes Title Case and sentence case within the same string' AS issue FROM kinds WHERE kind = 'mixed' AND {ENGLISH}",
    "d16_title_case": f"{E}, {VOTES} SELECT entry_id, CAST(0 AS INTEGER) AS issue_no, 'Sentence is written in Title Case - normal UI sentences should use sentence case (capitalize only the first word and any defined terminology)' AS issue FROM kinds WHERE kind = 'title' AND {ENGLISH}",
    "d17_repeated_word": unnested(REPEATED_TEXT),
    "d18_passive": f"{E} SELECT entry_id, CAST(0 AS INTEGER) AS issue_no, '\"' || m || '\" should be \"' || regexp_replace(m, '(?i)^(been|being){W}+handovers?$', '\\1 handed over') || '\"' AS issue FROM (SELECT entry_id, regexp_extract(v, {s(PASSIVE)}, 1) AS m FROM e WHERE {ENGLISH}) q WHERE m <> ''",
    "d19_glossary": f"{E}, {GLOSSARY} SELECT entry_id, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY ord) - 1 AS INTEGER) AS issue_no, '\"' || wrong || '\" should be \"' || canon || '\"' AS issue FROM e, g WHERE {ENGLISH} AND CASE WHEN contains(lower(v), wrong) THEN regexp_matches(v, '(?i)(?:^|{N})' || regexp_escape(wrong) || '(?:{N}|$)') ELSE false END AND NOT contains(v, canon)",
    "d20_number_of": simple(matches(f"(?i)(?:^|{N})No\\.{W}*of(?:{N}|$)"), K.M_NUMBER_OF, ENGLISH),
    "d21_identifier": f"{E}, {GLOSSARY}, i AS (SELECT entry_id, v, unnest({IDS}) AS t FROM e WHERE {ENGLISH}), j AS (SELECT entry_id, v, t, coalesce(canon, left(t, length(t) - 2) || ' ID') AS sp FROM i LEFT JOIN g ON wrong = lower(left(t, length(t) - 2) || ' ID')) "
    "SELECT entry_id, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY t) - 1 AS INTEGER) AS issue_no, '\"' || t || '\" should be \"' || sp || '\"' AS issue FROM j WHERE NOT contains(v, sp)",
    "d23_duplicates": "WITH r AS (SELECT entry_id, file, line, key, first_value(line) OVER w AS first_seen_line, row_number() OVER w AS n FROM parse_entries WHERE value IS NOT NULL AND key IS NOT NULL WINDOW w AS (PARTITION BY file, key ORDER BY line, entry_id)) SELECT entry_id, file, line, key, first_seen_line FROM r WHERE n > 1",
    "d24_flags": f"{E} SELECT entry_id, line, 'Grammar' AS category, unnest({REPEATED_TEXT}) AS issue FROM e",
    "w1_first_seen": "SELECT file, key, min(line) AS first_line, count(*) AS n FROM parse_entries WHERE key IS NOT NULL GROUP BY file, key HAVING count(*) > 1",
    "f01_trim": changed(replaced(f"^{W}+|{W}+$", "")),
    "f02_no_of": changed(replaced(f"No\\.{W}*Of({N}|$)", "No. of\\1")),
    "f03_number_of": changed(replaced(f"(?i)(^|{N})No\\.{W}*of({N}|$)", "\\1number of\\2")),
    "f04_passive": changed(replaced(f"(?i)(^|{N})(been|being){W}+handovers?({N}|$)", "\\1\\2 handed over\\3")),
    "f05_identifier": changed(rebuilt(f"{RUN}+", "CASE WHEN regexp_full_match(t, '[A-Za-z]*[a-z]ID') THEN left(t, length(t) - 2) || ' ID' ELSE t END")),
    "f06_double_space": changed(replaced(" {2,}", " ")),
    "f07_missing_space": changed(rebuilt(f"[.,!?;:][A-Za-z]{RUN}*", f"CASE WHEN substr(t, 2) IN {items(K.EXTENSIONS)} THEN t ELSE left(t, 1) || ' ' || substr(t, 2) END")),
    "f08_comma_case": changed(rebuilt(f",{W}+[A-Z]{RUN}*", f"CASE WHEN regexp_full_match(regexp_extract(t, '[A-Z]{RUN}*$'), '[A-Z][a-z]+') AND lower(regexp_extract(t, '[A-Z]{RUN}*$')) IN {items(K.CONTINUATIONS)} THEN ', ' || lower(regexp_extract(t, '[A-Z]{RUN}*$')) ELSE t END")),
    "f09_space_before_stop": changed(replaced(f"{W}+([,.])", "\\1")),
    "f10_space_before_mark": changed(replaced(f"{W}+([!?;:])", "\\1")),
    "f11_repeated_mark": changed("regexp_replace(regexp_replace(v, '!{2,}', '!', 'g'), '\\?{2,}', '?', 'g')"),
    "f12_double_period": changed(rebuilt("\\.+", "CASE WHEN length(t) = 2 THEN '.' ELSE t END")),
    "f13_comma_splice": changed(replaced(f"(?s)^(.*?),({W}+(?:{AUX})(?:[^.!?\\pL\\pN_][^.!?]*)?\\?)", "\\1.\\2", "")),
    "f14_fail_to": changed(replaced(f"(^|[.!?]{W}+)([Ff])ail({W}+to)({N}|$)", "\\1\\2ailed\\3\\4")),
    "f15_capitalize": changed(rebuilt(START, f"CASE WHEN {BAD_START} THEN left(t, length(t) - length({START_WORD})) || upper(left({START_WORD}, 1)) || substr({START_WORD}, 2) ELSE t END")),
    "f16_sentence_case": f"{E}, {RECASED} SELECT entry_id, after FROM (SELECT entry_id, v, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(new[i], '')), '') AS after FROM k4) q WHERE after <> v",
    "f17_glossary": f"{E.replace('WITH ', 'WITH RECURSIVE ', 1)}, {GLOSSARY}, n AS (SELECT row_number() OVER (ORDER BY ord) AS k, wrong, canon FROM g), "
    f"r AS (SELECT entry_id, v AS before, v, 0 AS k FROM e UNION ALL SELECT entry_id, before, CASE WHEN contains(lower(v), wrong) THEN regexp_replace(regexp_replace(v, '(?i)(^|{N})' || regexp_escape(wrong) || '({N}|$)', '\\1' || canon || '\\2', 'g'), '(?i)(^|{N})' || regexp_escape(wrong) || '({N}|$)', '\\1' || canon || '\\2', 'g') ELSE v END, n.k FROM r JOIN n ON n.k = r.k + 1) "
    "SELECT entry_id, v AS after FROM r WHERE k = (SELECT max(k) FROM n) AND v <> before",
    "k3_duplicates": "WITH r AS (SELECT file, line, key, value, first_value(line) OVER w AS first_seen_line, row_number() OVER w AS n FROM parse_entries WHERE value IS NOT NULL AND key IS NOT NULL WINDOW w AS (PARTITION BY file, key ORDER BY line, entry_id)) "
    "SELECT file, line, key, first_seen_line, value, 'Duplicate key - both copies kept as-is, needs manual decision on which is correct' AS note FROM r WHERE n > 1",
    "k5_spelling_notes": f"{E.replace('WHERE value IS NOT NULL', '')}, have AS (SELECT DISTINCT lang_code FROM (SELECT lang_code, unnest(regexp_extract_all(lower(v), '[a-z'']+')) AS word FROM e WHERE lang_code IN (SELECT code FROM languages WHERE has_speller)) q WHERE length(word) >= 2 GROUP BY lang_code, word HAVING count(*) >= 5) "
    "SELECT DISTINCT file, 'Note: no spelling dictionary installed for ''' || lang_code || ''' - spelling not checked, sheet reflects that, not ''no errors''' AS note FROM e WHERE lang_code NOT IN (SELECT lang_code FROM have)",
    "o1_files": "SELECT DISTINCT file FROM resource_lines",
    "a6_widths": "WITH r AS (SELECT line, key, value, row_number() OVER (PARTITION BY file, key ORDER BY line, entry_id) AS n FROM parse_entries WHERE value IS NOT NULL AND key IS NOT NULL) "
    "SELECT c AS \"column\", CAST(least(80, 2 + greatest(10, length(c), coalesce(m, 0))) AS INTEGER) AS width FROM (SELECT unnest(['line', 'key', 'value']) AS c, unnest([max(length(CAST(line AS VARCHAR))), max(length(key)), max(length(value))]) AS m FROM r WHERE n > 1) q",
    "x18_match_case": f"{E}, {TOKENS} SELECT word, CASE WHEN word = upper(word) AND word <> lower(word) THEN 'FIXED' WHEN left(word, 1) <> lower(left(word, 1)) AND substr(word, 2) = lower(substr(word, 2)) AND substr(word, 2) <> upper(substr(word, 2)) THEN 'Fixed' WHEN word = lower(word) AND word <> upper(word) THEN 'fixed' ELSE 'fiXed' END AS cased FROM tok",
    "spell_p00_checked": f"{E.replace('WHERE value IS NOT NULL', '')} SELECT lang_code, count(*) FILTER (WHERE coalesce(has_speller, false)) AS n_checked, count(*) AS n FROM e LEFT JOIN languages ON code = lang_code GROUP BY lang_code",
    "spell_p02_stray_quotes": f"{E}, q AS (SELECT entry_id, list_filter(regexp_extract_all(regexp_replace(v, '\\[[^\\]]*\\]', '#', 'g'), '[A-Za-z]+[\"‘’“”][A-Za-z]+'), lambda x: x <> upper(x)) AS w FROM e WHERE {ENGLISH}) SELECT entry_id, CAST(i - 1 AS INTEGER) AS no, w[i] AS word, regexp_replace(w[i], '[\"‘’“”]', '''', 'g') AS fix FROM q, unnest(range(1, len(w) + 1)) t(i)",
    "spell_p03_tokens": f"{E}, {TOKENS} SELECT word, n FROM tok",
    "spell_p06_inflected": f"{E}, {TOKENS}, {CUSTOM}, inf AS (SELECT word || unnest({['', *K.INFLECTIONS]}) AS low FROM custom) SELECT word, n FROM tok WHERE lower(word) IN (SELECT low FROM inf)",
    "spell_p08_real_words": f"{E}, {TOKENS}, fx AS (SELECT * FROM (VALUES {', '.join(f'({s(a)}, {s(b)})' for a, b in K.REAL_WORDS.items())}) t(a, b)) SELECT word, n, b AS fix FROM tok JOIN fx ON lower(word) = a",
    "spell_p09_oov": f"{OOV} SELECT word FROM oov",
    "spell_p09_lexicon": f"{E}, {LEXICON} SELECT word, freq FROM lex",
    "spell_p10_prefix": f"{OOV}, c AS ({PREFIX_ROWS}) SELECT word, string_agg(DISTINCT form, ',' ORDER BY form) AS rests FROM c WHERE form IN (SELECT word FROM lex) GROUP BY word",
    "spell_p11_regional": f"{OOV}, c AS ({REGION_ROWS}) SELECT word, string_agg(DISTINCT form, ',' ORDER BY form) AS forms FROM c WHERE form IN (SELECT word FROM lex) GROUP BY word",
    "spell_p12_known_fixes": f"{OOV}, fx AS (SELECT * FROM (VALUES {', '.join(f'({s(a)}, {s(b)})' for a, b in (K.CONTRACTIONS | K.TYPOS).items())}) t(a, b)) SELECT word, b AS fix FROM oov JOIN fx ON low = a",
    "spell_p13_stray_capital": f"{E}, {LEXICON}, {TOKENS} SELECT word, lower(word) AS fix FROM tok WHERE regexp_matches(substr(word, 2), '[A-Z]') AND lower(word) IN (SELECT word FROM lex)",
    "spell_p14_transposition": f"{OOV}, c AS (SELECT word, left(low, i - 1) || substr(low, i + 1, 1) || substr(low, i, 1) || substr(low, i + 2) AS form FROM oov, unnest(range(1, length(low))) t(i) WHERE substr(low, i, 1) <> substr(low, i + 1, 1)) SELECT word, min(form) AS fix FROM c WHERE form IN (SELECT word FROM lex) GROUP BY word HAVING count(DISTINCT form) = 1",
    "spell_p16_domain_words": f"{OOV}, {CUSTOM} SELECT oov.word, custom.word AS target, CAST(levenshtein(low, custom.word) AS INTEGER) AS d FROM oov, custom WHERE length(oov.word) >= 3 AND length(custom.word) >= 4 AND levenshtein(low, custom.word) <= 2",
    "spell_p17_near_words": f"{OOV} SELECT oov.word, lex.word AS target, CAST(levenshtein(low, lex.word) AS INTEGER) AS d FROM oov, lex WHERE length(oov.word) >= 3 AND length(lex.word) >= 2 AND levenshtein(low, lex.word) <= 2",
    "spell_p19_compound_split": f"{OOV}, c AS (SELECT word, left(low, i) AS a, substr(low, i + 1) AS b FROM oov, unnest(range(3, length(low) - 2)) t(i) WHERE word = low AND length(word) >= 6) SELECT word, count(*) AS n_splits, min(a || ' ' || b) AS first_split FROM c WHERE a IN (SELECT word FROM lex) AND b IN (SELECT word FROM lex) GROUP BY word",
}


def _expression(step: str) -> str:
    """The expression of a single step, as its own form has it."""
    return SQL[step].split("SELECT entry_id, v, ", 1)[1].rsplit(" AS after FROM e) q", 1)[0]


_LABELS = {
    "f01_trim": K.L_TRIM, "f02_no_of": K.L_NO_OF, "f03_number_of": K.L_NUMBER_OF, "f04_passive": K.L_PASSIVE, "f05_identifier": K.L_ID, "f06_double_space": K.L_DOUBLE_SPACE,
    "f07_missing_space": K.L_MISSING_SPACE, "f08_comma_case": K.L_COMMA, "f09_space_before_stop": K.L_SPACE_BEFORE, "f10_space_before_mark": K.L_SPACE_BEFORE,
    "f11_repeated_mark": K.L_REPEATED, "f12_double_period": K.L_DOUBLE_PERIOD, "f13_comma_splice": K.L_SPLICE, "f14_fail_to": K.L_FAIL, "f15_capitalize": K.L_START,
}


def _pipeline() -> str:
    """Tables up to ``fx``: all structural steps one after another, each on what the one before leaves, with the labels of those that change it."""
    label = "CASE WHEN after <> v THEN list_append(labels, {}) ELSE labels END AS labels"
    out = [E.replace("WITH ", "WITH RECURSIVE ", 1), LISTS, "s0 AS MATERIALIZED (SELECT entry_id, lang_code, v, v AS before, CAST([] AS VARCHAR[]) AS labels FROM e)"]
    for i, (step, name) in enumerate(_LABELS.items(), 1):
        out.append(f"s{i} AS MATERIALIZED (SELECT entry_id, lang_code, after AS v, before, {label.format(s(name))} FROM (SELECT *, {_expression(step)} AS after FROM s{i - 1}) q)")
    n = len(_LABELS)
    out.append(RECASED.split(", c0 AS", 1)[1].join(["c0 AS", ""]).replace("FROM e)", f"FROM s{n})", 1))
    out.append("k5 AS (SELECT entry_id, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(new[i], '')), '') AS recased FROM k4)")
    out.append(f"t0 AS MATERIALIZED (SELECT entry_id, after AS v, before, {label.format(s(K.L_CASING))} FROM (SELECT s{n}.*, coalesce(recased, v) AS after FROM s{n} LEFT JOIN k5 USING (entry_id)) q)")
    out.append("n AS (SELECT row_number() OVER (ORDER BY ord) AS k, wrong, canon FROM g)")
    whole = f"'(?i)(^|{N})' || regexp_escape(wrong) || '({N}|$)', '\\1' || canon || '\\2', 'g'"
    out.append(
        "r AS (SELECT entry_id, v, v AS old, before, labels, 0 AS k FROM t0 UNION ALL SELECT entry_id, CASE WHEN contains(lower(v), wrong) THEN "
        f"regexp_replace(regexp_replace(v, {whole}), {whole}) ELSE v END, old, before, labels, n.k FROM r JOIN n ON n.k = r.k + 1)"
    )
    out.append(f"fx AS MATERIALIZED (SELECT entry_id, before, v AS fixed, CASE WHEN v <> old THEN list_append(labels, {s(K.L_GLOSSARY)}) ELSE labels END AS labels FROM r WHERE k = (SELECT max(k) FROM n))")
    return ", ".join(out)


def _counts() -> str:
    """Issues of every entry by category, from the forms of the single rules."""
    kinds = {"spacing": ("d01", "d02", "d03", "d04", "d05", "d06"), "terminology": ("d19", "d20", "d21"), "grammar": ("d07", "d08", "d09", "d10", "d11", "d12", "d13", "d14", "d15", "d16", "d17", "d18")}
    parts = [f"SELECT entry_id, '{kind}' AS kind FROM ({SQL[name]}) q" for kind, ids in kinds.items() for name in SQL if name[:3] in ids]
    sums = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind in kinds)
    return f"SELECT entry_id, {sums} FROM ({' UNION ALL '.join(parts)}) q GROUP BY entry_id"


SQL["fix_steps"] = f"{_pipeline()} SELECT entry_id, fixed, array_to_string(labels, '; ') AS labels FROM fx WHERE len(labels) > 0"
SQL["detect_counts"] = _counts()

_FIXES = lambda words: ", ".join(f"({s(a)}, {s(b)})" for a, b in words.items())
_REST = " UNION ALL ".join(f"SELECT lang, word, substr(low, {len(p) + 1}) AS form FROM o WHERE starts_with(low, {s(p)}) AND length(low) >= {len(p) + 3}" for p in K.PREFIXES)
_REGION = " UNION ALL ".join(
    f"SELECT lang, word, left(low, length(low) - {len(x)}) || {s(y)} FROM o WHERE ends_with(low, {s(x)})" for a, b in K.SUFFIX_PAIRS for x, y in ((a, b), (b, a))
)
#: Entries in the languages that have a dictionary, from which lexicons are made.
_SPOKEN = "sx AS (SELECT entry_id, lang_code AS lang, v FROM e WHERE lang_code IN (SELECT code FROM languages WHERE has_speller))"
#: The spelling cascade over the words of ``sp`` (entry_id, lang, v), decision by decision, and the hits of every value.
_CASCADE = (
    "lex AS MATERIALIZED (SELECT lang, word, count(*) AS freq FROM (SELECT lang, unnest(regexp_extract_all(lower(v), '[a-z'']+')) AS word FROM sx) q WHERE length(word) >= 2 GROUP BY lang, word HAVING count(*) >= 5), "
    "tl AS (SELECT entry_id, lang, list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(v, '\\[[^\\]]*\\]', '#', 'g'), '[A-Za-z]+[\"‘’“”][A-Za-z]+', '#', 'g'), '[A-Za-z'']+'), lambda x: regexp_replace(x, '^''+|''+$', '', 'g')), "
    "lambda x: length(x) >= 3 AND NOT (x = upper(x) AND x <> lower(x)) AND NOT regexp_full_match(x, '[A-Za-z]*[a-z]ID')) AS words FROM sp WHERE lang IN (SELECT lang FROM lex)), "
    f"skip AS (SELECT word || unnest({['', *K.INFLECTIONS]}) AS low FROM (SELECT word FROM custom UNION SELECT wrong FROM g) q), "
    "o AS MATERIALIZED (SELECT DISTINCT lang, word, lower(word) AS low FROM (SELECT lang, unnest(words) AS word FROM tl) q WHERE lower(word) NOT IN (SELECT low FROM skip) AND lower(word) <> 'cancelled'), "
    f"rw AS (SELECT * FROM (VALUES {_FIXES(K.REAL_WORDS)}) t(low, fix)), kf AS (SELECT * FROM (VALUES {_FIXES(K.CONTRACTIONS | K.TYPOS)}) t(low, fix)), "
    f"ac AS (SELECT DISTINCT c.lang, c.word FROM ({_REST} UNION ALL {_REGION}) c JOIN lex ON lex.lang = c.lang AND lex.word = form), "
    "d1 AS MATERIALIZED (SELECT o.*, rw.fix AS real_fix, lex.word IS NOT NULL AS is_real FROM o LEFT JOIN rw USING (low) LEFT JOIN lex ON lex.lang = o.lang AND lex.word = o.low), "
    "d2 AS MATERIALIZED (SELECT d1.* FROM d1 LEFT JOIN ac ON ac.lang = d1.lang AND ac.word = d1.word WHERE real_fix IS NOT NULL OR (ac.word IS NULL AND (NOT is_real OR NOT (d1.word = low OR (d1.word = upper(d1.word) AND d1.word <> lower(d1.word)) OR substr(d1.word, 2) = substr(low, 2))))), "
    "sw AS (SELECT c.lang, c.word, min(form) AS swapped FROM (SELECT lang, word, left(low, i - 1) || substr(low, i + 1, 1) || substr(low, i, 1) || substr(low, i + 2) AS form FROM d2, unnest(range(1, length(low))) t(i) WHERE substr(low, i, 1) <> substr(low, i + 1, 1)) c JOIN lex ON lex.lang = c.lang AND lex.word = form GROUP BY c.lang, c.word HAVING count(DISTINCT form) = 1), "
    "d3 AS MATERIALIZED (SELECT d2.*, kf.fix AS known, swapped, CASE WHEN real_fix IS NOT NULL THEN 'real word' WHEN kf.fix IS NOT NULL THEN 'known fix' WHEN is_real THEN 'stray capital' WHEN swapped IS NOT NULL THEN 'transposition' END AS step FROM d2 LEFT JOIN kf USING (low) LEFT JOIN sw ON sw.lang = d2.lang AND sw.word = d2.word), "
    "nw AS (SELECT d3.lang, d3.word, lex.word AS target, levenshtein(low, lex.word) AS d, freq FROM d3 JOIN lex ON lex.lang = d3.lang AND abs(length(lex.word) - length(low)) <= 2 WHERE step IS NULL AND levenshtein(low, lex.word) <= 2), "
    "top AS (SELECT lang, word, min(d) AS d, list(target ORDER BY d, freq DESC, target) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY lang, word ORDER BY d, freq DESC, target) AS k FROM nw) q WHERE k <= 3 GROUP BY lang, word), "
    "dw AS (SELECT DISTINCT d3.word, custom.word AS target, levenshtein(low, custom.word) AS d FROM d3, custom WHERE step IS NULL AND length(custom.word) >= 4 AND abs(length(custom.word) - length(low)) <= 2 AND levenshtein(low, custom.word) <= 2), "
    "dm AS (SELECT word, min(d) AS dd, arg_min(target, d) AS domain FROM dw GROUP BY word), dt AS (SELECT dm.*, (SELECT count(*) FROM dw WHERE dw.word = dm.word AND dw.d = dm.dd) AS ties FROM dm), "
    "cs AS (SELECT c.lang, c.word, list(a || ' ' || b ORDER BY a) AS splits, list(a) AS heads FROM (SELECT lang, word, left(low, i) AS a, substr(low, i + 1) AS b FROM d3, unnest(range(3, length(low) - 2)) t(i) WHERE step IS NULL AND length(low) >= 6) c "
    "JOIN lex x ON x.lang = c.lang AND x.word = a JOIN lex y ON y.lang = c.lang AND y.word = b GROUP BY c.lang, c.word), "
    "d4 AS (SELECT d3.*, top.d AS raw_d, coalesce(raw, []) AS raw, dd, domain, ties, splits, heads, regexp_extract(d3.word, '^(.*?[a-z])[A-Z]', 1) AS camel FROM d3 LEFT JOIN top ON top.lang = d3.lang AND top.word = d3.word LEFT JOIN dt ON dt.word = d3.word LEFT JOIN cs ON cs.lang = d3.lang AND cs.word = d3.word), "
    "d5 AS (SELECT *, CASE WHEN step IS NOT NULL THEN step WHEN ties = 1 AND dd < coalesce(raw_d, 99) THEN 'domain word' WHEN raw_d <= 2 THEN 'near word' "
    "WHEN length(camel) >= 4 AND length(word) - length(camel) >= 4 AND list_contains(heads, lower(camel)) THEN 'camel split' WHEN word = low AND len(splits) = 1 THEN 'compound split' ELSE 'open' END AS decided FROM d4), "
    "vd AS MATERIALIZED (SELECT lang, word, decided AS step, decided <> 'open' AS confident, CASE decided WHEN 'real word' THEN [real_fix] WHEN 'known fix' THEN [known] WHEN 'stray capital' THEN [low] WHEN 'transposition' THEN [swapped] WHEN 'domain word' THEN [domain] "
    "WHEN 'camel split' THEN [camel || ' ' || substr(word, length(camel) + 1)] WHEN 'compound split' THEN splits ELSE raw END AS suggestions FROM d5)"
)
_CASCADE += (
    ", qh AS (SELECT entry_id, list_filter(regexp_extract_all(regexp_replace(v, '\\[[^\\]]*\\]', '#', 'g'), '[A-Za-z]+[\"‘’“”][A-Za-z]+'), lambda x: NOT (x = upper(x) AND x <> lower(x))) AS w FROM sp WHERE lang IN (SELECT lang FROM lex)), "
    "hits AS MATERIALIZED (SELECT entry_id, i - 1000001 AS pos, w[i] AS word, regexp_replace(w[i], '[\"‘’“”]', '''', 'g') AS tip, true AS confident FROM qh, unnest(range(1, len(w) + 1)) t(i) "
    "UNION ALL SELECT entry_id, i - 1, vd.word, suggestions[1], confident FROM tl, unnest(range(1, len(words) + 1)) t(i) JOIN vd ON vd.lang = tl.lang AND vd.word = words[i])"
)
_WHOLE_WORD = f"'(^|{N})' || regexp_escape(word) || '({N}|$)', '\\1' || new || '\\2', 'g'"
_SPELLED = (
    "hh AS MATERIALIZED (SELECT entry_id, row_number() OVER (PARTITION BY entry_id ORDER BY pos, word) AS k, word, CASE WHEN word = upper(word) AND word <> lower(word) THEN upper(tip) "
    "WHEN left(word, 1) <> lower(left(word, 1)) AND substr(word, 2) = lower(substr(word, 2)) AND substr(word, 2) <> upper(substr(word, 2)) THEN upper(left(tip, 1)) || lower(substr(tip, 2)) "
    "WHEN word = lower(word) AND word <> upper(word) THEN lower(tip) ELSE tip END AS new FROM hits WHERE confident AND tip IS NOT NULL), "
    f"rr AS (SELECT entry_id, v, 0 AS k FROM sp UNION ALL SELECT rr.entry_id, regexp_replace(regexp_replace(v, {_WHOLE_WORD}), {_WHOLE_WORD}), hh.k FROM rr JOIN hh ON hh.entry_id = rr.entry_id AND hh.k = rr.k + 1), "
    "sl AS MATERIALIZED (SELECT entry_id, arg_max(v, k) AS spelled FROM rr GROUP BY entry_id)"
)
_VERDICTS = f"{E.replace('WITH ', 'WITH RECURSIVE ', 1)}, {CUSTOM}, {GLOSSARY}, {_SPOKEN}, sp AS (SELECT * FROM sx), {_CASCADE}"
SQL["spell_p20_verdicts"] = f"{_VERDICTS} SELECT lang, word, array_to_string(suggestions, ', ') AS suggestions, confident, step FROM vd"
_ISSUE = "'Possible misspelling: \"' || word || '\"' || CASE WHEN tip IS NULL THEN '' ELSE ' (did you mean \"' || tip || '\"?)' END AS issue"
SQL["d22_spelling"] = f"{_VERDICTS} SELECT entry_id, CAST(pos AS INTEGER) AS pos, {_ISSUE} FROM hits"
SQL["f18_spelling"] = f"{_VERDICTS}, {_SPELLED} SELECT entry_id, spelled AS after FROM sl JOIN e USING (entry_id) WHERE spelled <> v"


def _corrected(lang: str) -> str:
    """Tables up to ``al`` (entry_id, before, fixed, labels): all steps with spelling last, in the language given by an expression."""
    label = f"CASE WHEN spelled <> fixed THEN list_append(labels, {s(K.L_SPELLING)}) ELSE labels END AS labels"
    return (
        f"{_pipeline()}, {_SPOKEN}, sp AS (SELECT entry_id, {lang} AS lang, fixed AS v FROM fx JOIN e USING (entry_id)), {_CASCADE}, {_SPELLED}, "
        f"al AS MATERIALIZED (SELECT entry_id, before, coalesce(spelled, fixed) AS fixed, {label} FROM fx LEFT JOIN sl USING (entry_id))"
    )


_ENGLISH_FIXES = _corrected("'en'")
_DIFFS = "SELECT entry_id, line, key, before, fixed AS after, array_to_string(labels, '; ') AS categories FROM al JOIN e USING (entry_id) WHERE len(labels) > 0"
SQL["q1_differences"] = f"{_ENGLISH_FIXES} {_DIFFS}"
SQL["u2_diff_report"] = (
    f"{_ENGLISH_FIXES} SELECT file, line, key, 'auto-fixed' AS type, array_to_string(labels, '; ') AS categories_or_category, before AS before_or_issue, fixed AS after FROM al JOIN e USING (entry_id) WHERE len(labels) > 0 "
    f"UNION ALL SELECT file, line, key, 'needs-review', 'Grammar', unnest({REPEATED_TEXT}), '' FROM e"
)
SQL["a1_run_stats"] = (
    f"{_ENGLISH_FIXES}, du AS (SELECT file, count(*) AS duplicates FROM ({SQL['k3_duplicates']}) q GROUP BY file) "
    f"SELECT file, count(*) AS total, count(*) FILTER (WHERE len(labels) > 0) AS auto_fixed, CAST(sum(len({REPEATED_TEXT})) AS BIGINT) AS flagged, any_value(coalesce(duplicates, 0)) AS duplicates FROM al JOIN e USING (entry_id) LEFT JOIN du USING (file) GROUP BY file"
)
#: Routed entries: the fixes in the language of the file, issues of the value as it stands.
_ROUTED = (
    f"{_corrected('lang_code')}, iss AS ({SQL['detect_counts']}), sps AS (SELECT entry_id, count(*) AS n_spelling FROM ({SQL['d22_spelling']}) q GROUP BY entry_id), "
    "cn AS (SELECT e.entry_id, file, line, lang_code, v, before, fixed, labels, coalesce(n_grammar, 0) AS n_grammar, coalesce(n_terminology, 0) AS n_terminology, coalesce(n_spacing, 0) AS n_spacing, coalesce(n_spelling, 0) AS n_spelling "
    "FROM e JOIN al USING (entry_id) LEFT JOIN iss USING (entry_id) LEFT JOIN sps USING (entry_id)), "
    "ro AS MATERIALIZED (SELECT *, CASE greatest(n_spelling, n_grammar, n_terminology, n_spacing) WHEN 0 THEN NULL WHEN n_spelling THEN 'Spelling' WHEN n_grammar THEN 'Grammar' WHEN n_terminology THEN 'Terminology' ELSE 'Spacing' END AS category FROM cn)"
)
SQL["q3_report"] = (
    f"{_ROUTED} SELECT entry_id, file, line, lang_code, category, n_grammar, n_terminology, n_spacing, CASE WHEN fixed = before THEN '(needs manual review - no confident auto-suggestion)' ELSE fixed END AS suggested, array_to_string(labels, '; ') AS changes_applied FROM ro"
)
SQL["q7_clean"] = f"{_ROUTED} SELECT entry_id, v AS value FROM ro WHERE category IS NULL"
_STATS = (
    f"{_ROUTED}, du AS (SELECT file, count(*) AS duplicates FROM ({SQL['k3_duplicates']}) q GROUP BY file), st AS (SELECT file, lang_code, coalesce(name, 'Unknown') AS lang_name, CASE lang_code WHEN 'unknown' THEN 'unknown' ELSE 'filename' END AS detection, count(*) AS total, "
    "count(*) FILTER (WHERE category = 'Spelling') AS spelling, count(*) FILTER (WHERE category = 'Grammar') AS grammar, count(*) FILTER (WHERE category = 'Terminology') AS terminology, count(*) FILTER (WHERE category = 'Spacing') AS spacing, "
    "count(*) FILTER (WHERE category IS NULL) AS clean, any_value(coalesce(duplicates, 0)) AS duplicates FROM ro LEFT JOIN languages ON code = lang_code LEFT JOIN du USING (file) GROUP BY file, lang_code, name)"
)
SQL["a2_file_stats"] = f"{_STATS} SELECT * FROM st"
SQL["a2_category_pivot"] = f'{_STATS} SELECT file, spelling AS "Spelling", grammar AS "Grammar", terminology AS "Terminology", spacing AS "Spacing", clean AS "Clean" FROM st'
_METRICS = (
    ("File", "file"), ("Detected language", "lang_name || ' (' || lang_code || ')'"), ("Language detection method", "detection"), ("Total strings", "CAST(total AS VARCHAR)"),
    ("Sheet assignment", "'Each string appears in exactly ONE sheet - priority: Spelling > Grammar > Terminology > Spacing'"), ("Spelling issues", "CAST(spelling AS VARCHAR)"),
    ("Grammar issues", "CAST(grammar AS VARCHAR)"), ("Terminology issues", "CAST(terminology AS VARCHAR)"), ("Spacing issues", "CAST(spacing AS VARCHAR)"),
    ("Duplicate keys", "CAST(duplicates AS VARCHAR)"), ("Clean strings (no issues in any category)", "CAST(clean AS VARCHAR)"), ("LanguageTool server used", "'no - spelling sheet incomplete'"),
)
SQL["q8_summary"] = f"{_STATS} " + " UNION ALL ".join(f"SELECT file, CAST({i} AS INTEGER) AS ord, {s(name)} AS metric, {value} AS value FROM st" for i, (name, value) in enumerate(_METRICS, 1))
