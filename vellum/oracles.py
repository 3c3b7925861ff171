"""Equivalent SQL of the registered queries, for DuckDB."""

from __future__ import annotations

from vellum.functions import normalize as norm, validators
from vellum.functions.dialect import SPACES, re2, sql_string as s
from vellum.operators import lexicon_data as data, rules, score

_MARK = "chr(57348)"


def strip_invisible(x: str) -> str:
    return f"regexp_replace({x}, {s(norm.INVISIBLE)}, '', 'g')"


def line_feeds(x: str) -> str:
    return f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def trim_space(x: str) -> str:
    return f"regexp_replace({x}, {s(f'^[{SPACES}]+|[{SPACES}]+$')}, '', 'g')"


def shared(x: str) -> str:
    return trim_space(line_feeds(strip_invisible(f"coalesce({x}, '')")))


def ascii_punctuation(x: str) -> str:
    source = norm.SINGLE_QUOTES + norm.DOUBLE_QUOTES + norm.DASHES + norm.EXOTIC_SPACES
    target = "'" * 4 + '"' * 4 + "-" * 7 + " " * len(norm.EXOTIC_SPACES)
    return f"translate({x}, {s(source)}, {s(target)})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {s(f'[{SPACES}]+')}, ' ', 'g'))"


def upper_ratio(x: str) -> str:
    letters = f"length(regexp_replace({x}, '[^a-zA-Z]', '', 'g'))"
    return f"CASE WHEN {letters} > 0 THEN length(regexp_replace({x}, '[^A-Z]', '', 'g'))::DOUBLE / {letters} ELSE 0.0::DOUBLE END"


def caps_fires(x: str, profile: str = "documented") -> str:
    return f"(NOT regexp_matches(trim({x}), {s(norm.LABEL[profile])}) AND length({x}) > {norm.CAPS_LENGTH} AND {upper_ratio(x)} > {norm.CAPS_SHARE})"


def _raised(x: str) -> str:
    """Marked places raised: the letter after each mark."""
    return f"array_to_string(list_transform(string_split({x}, {_MARK}), lambda p, i: CASE WHEN i = 1 THEN p ELSE upper(p[1:1]) || p[2:] END), '')"


def sentence_case(x: str) -> str:
    return f"regexp_replace({_raised(f'''regexp_replace(lower({x}), '(^|[.!?] )([a-z])', '\\1' || {_MARK} || '\\2', 'g')''')}, '\\bi\\b', 'I', 'g')"


def tidy_punctuation(x: str) -> str:
    for mark in ("[.]", "!", "[?]"):
        x = f"regexp_replace({x}, '{mark}{mark}+', '{mark.strip('[]')}', 'g')"
    x = f"regexp_replace({x}, ' ([,;:!?.])', '\\1', 'g')"
    x = f"regexp_replace({x}, '([,;:!?.])([a-zA-Z])', '\\1 \\2', 'g')"
    return f"regexp_replace({x}, {s(f',[{SPACES}]+')}, ', ', 'g')"


def sentence_bounds(x: str) -> str:
    return f"regexp_replace({x}, '([a-z])( )([A-Z][a-z]{{2,}})', '\\1.\\2\\3', 'g')"


def raise_starts(x: str) -> str:
    start = f"regexp_replace({x}, {s(chr(94) + '([' + chr(34) + chr(39) + '(\\[{]*)([a-z])')}, '\\1' || {_MARK} || '\\2')"
    return _raised(f"regexp_replace({start}, '([.!?] )([a-z])', '\\1' || {_MARK} || '\\2', 'g')")


def normalised(source: str, keys: str, text: str = "text") -> str:
    """CTEs up to n: keys, text, text_regex, text_nlp, was_caps_converted; for texts without code blocks."""
    prose, nlp = collapse(ascii_punctuation("masked")), sentence_bounds(tidy_punctuation(collapse(ascii_punctuation("masked"))))
    return f"""m AS (SELECT {keys}, {text} AS text, {shared(text)} AS masked FROM {source}),
p AS (SELECT {keys}, text, masked, {prose} AS prose, {nlp} AS nlp FROM m),
g AS (SELECT *, {caps_fires('prose')} AS caps_r, {caps_fires('nlp')} AS caps_n FROM p),
n AS (SELECT {keys}, text, masked, CASE WHEN caps_r THEN {sentence_case('prose')} ELSE prose END AS text_regex,
  {raise_starts(f"(CASE WHEN caps_n THEN {sentence_case('nlp')} ELSE nlp END)")} AS text_nlp, caps_r OR caps_n AS was_caps_converted FROM g)"""


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '', 'g')"


def luhn(d: str) -> str:
    """Luhn check of a string of digits."""
    return f"""(list_sum(list_transform(string_split(reverse({d}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN try_cast(c AS INT)
  ELSE (CASE WHEN try_cast(c AS INT) * 2 > 9 THEN try_cast(c AS INT) * 2 - 9 ELSE try_cast(c AS INT) * 2 END) END)) % 10 = 0)"""


PLACE = f"regexp_matches(lower({{}}), {s('|'.join(validators.SHORTEST_PLACES))})"


def clean(m: str) -> str:
    return f"trim(regexp_replace(trim({m}), '^[\"''`]|[\"''`]$', '', 'g'))"


def passes(predicate: str | None, m: str) -> str:
    d = _digits(m)
    if predicate == "email":
        return f"(regexp_full_match({clean(m)}, {s(validators.EMAIL)}) AND length(split_part({clean(m)}, '@', 1)) <= 64 AND length(split_part({clean(m)}, '@', 2)) <= 254)"
    full = {"jwt": validators.JWT, "ipv4": validators.IPV4, "ipv6": validators.IPV6, "mac": validators.MAC}
    if predicate in full:
        return f"regexp_full_match({clean(m)}, {s(full[predicate])})"
    return {
        None: "true",
        "card": f"(length({d}) BETWEEN 13 AND 19 AND {luhn(d)})",
        "mobile_ph": f"regexp_full_match(CASE WHEN {d} LIKE '63%' THEN '0' || {d}[3:] ELSE {d} END, '09[0-9]{{9}}')",
        "mobile": f"regexp_full_match(regexp_replace({m}, '[\\s()+.-]', '', 'g'), '[0-9]{{7,15}}')",
        "address": PLACE.format(m),
    }[predicate]


def safe(rule_id: str, m: str) -> str:
    label = f"split_part({m}, ':', 1) || ': [REDACTED]'"
    sep = f"(CASE WHEN contains({m}, ':') THEN ':' ELSE '-' END)"
    return {
        # every digit followed by four more: of a run of n digits all but the last four
        "credit_card": f"array_to_string(list_transform(regexp_extract_all({m}, '[0-9]+|[^0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') AND length(r) > 4 THEN repeat('*', length(r) - 4) || right(r, 4) ELSE r END), '')",
        "api_key": f"regexp_replace({m}, '[A-Za-z0-9_.+/=-]{{20,}}', '[REDACTED-KEY]')",
        "jwt": "'[REDACTED-JWT]'",
        "email": f"left({m}, 1) || '***@' || split_part({m}, '@', 2)",
        "ph_mobile": f"{m}[:length({m}) - 6] || 'xxxxxx'",
        "phone_intl": f"{m}[:length({m}) - 4] || 'xxxx'",
        "ipv4": f"split_part({m}, '.', 1) || '.' || split_part({m}, '.', 2) || '.xxx.xxx'",
        "ipv6": "'[REDACTED-IPv6]'",
        "mac_address": f"left({m}, 2) || {sep} || {m}[4:5] || repeat({sep} || 'xx', 4)",
        "source_code": "'[CODE BLOCK REMOVED]'",
        "id_label": label,
        "personal_label": label,
        "ph_address": "'[PHILIPPINE ADDRESS REMOVED]'",
    }[rule_id]


def rule_rows(rule: rules.Rule, source: str, keys: str, text: str) -> str:
    """One rule's kept matches: keys, pattern_id, risk, raw_match, safe_version, validated, ord."""
    k = rules.RULES.index(rule)
    found = f"SELECT {keys}, {text} AS t_, regexp_extract_all({text}, {s(re2(rule.pattern))}) AS ms FROM {source}"
    kept = f"SELECT {keys}, list_filter(ms, lambda m: {passes(rule.predicate, 'm')}) AS ks FROM ({found})"
    each = f"SELECT {keys}, unnest(ks) AS raw_match, unnest(range(len(ks))) AS i FROM ({kept})"
    return f"SELECT {keys}, '{rule.id}' AS pattern_id, '{rule.risk}' AS risk, raw_match, {safe(rule.id, 'raw_match')} AS safe_version, true AS validated, ({k * rules.STEP} + i)::BIGINT AS ord FROM ({each})"


def term_rows(source: str, keys: str) -> str:
    """First hits of the terms in text_nlp."""
    values, order = [], 200 * rules.STEP
    for category, terms in data.TERMS.items():
        _, made = data.TERM_LABEL.get(category, ("", "[REDACTED]"))
        before, _, after = made.partition("{}")
        for term in terms:
            values.append(f"('gazetteer_{category}', '{data.TERM_RISK[category]}', {s(rf'(?i)\b{term}\b')}, {s(before)}, {s(after)}, {'true' if '{}' in made else 'false'}, {order})")
            order += 1
    return f"""SELECT {keys}, pattern_id, risk, raw_match, CASE WHEN with_term THEN before_ || raw_match || after_ ELSE before_ END AS safe_version, NULL::BOOLEAN AS validated, ord
FROM (SELECT {keys}, t.*, regexp_extract(text_nlp, t.pattern) AS raw_match FROM {source}, (VALUES {', '.join(values)}) AS t(pattern_id, risk, pattern, before_, after_, with_term, ord)) WHERE raw_match <> ''"""


def _list(words) -> str:
    return "[" + ", ".join(s(w) for w in words) + "]"


def similarity(a: str, b: str) -> str:
    """Edit distances count characters here: all beyond ASCII is one sign, which no phrase holds."""
    plain = f"regexp_replace({a}, '[^\\x00-\\x7F]', '?', 'g')"
    return f"(1.0::DOUBLE - levenshtein({plain}, {b})::DOUBLE / greatest(length({plain}), length({b})))"


def trigger_rows(source: str, keys: str) -> str:
    """Values after the first similar window of each trigger phrase."""
    stop = _list(dict.fromkeys(data.STOP_WORDS))
    values = ", ".join(
        f"({k}, {s(p)}, {p.count(' ') + 1}, '{c}', '{r}', {s(data.CATEGORY[c][1]) if data.CATEGORY[c][1] else 'NULL'}, {s('|'.join(data.TERMS[need])) if need else 'NULL'})"
        for k, (p, c, r, need) in enumerate(data.TRIGGERS)
    )
    ok = f"""length(neat) >= 2 AND len(list_filter(string_split(lower(neat), ' '), lambda w: w <> '' AND NOT list_contains({stop}, w))) > 0 AND CASE category
 WHEN 'person_name' THEN NOT regexp_matches(neat, '^[0-9]') WHEN 'age' THEN regexp_matches(neat, '^[0-9]') WHEN 'dob' THEN regexp_matches(neat, '[0-9]')
 WHEN 'location' THEN {PLACE.format('neat')} OR len(list_filter(string_split(lower(neat), ' '), lambda w: length(w) >= 3 AND NOT list_contains({stop}, w))) > 0
 WHEN 'health' THEN regexp_matches(lower(neat), {s('|'.join(data.TERMS['medical']))}) WHEN 'religion' THEN regexp_matches(lower(neat), {s('|'.join(data.TERMS['nationality_religion']))})
 WHEN 'financial' THEN regexp_matches(neat, '[0-9]') OR regexp_matches(lower(neat), {s('|'.join(data.TERMS['financial']))}) ELSE true END"""
    return f"""SELECT {keys}, 'trigger_' || category AS pattern_id, risk, trig || ' ' || span AS raw_match, trig || ' ' || coalesce(safe, left(neat, 1) || '***') AS safe_version,
 NULL::BOOLEAN AS validated, ({300 * rules.STEP} + k)::BIGINT AS ord FROM (
 SELECT *, array_to_string(list_transform(string_split(lower(span), ' '), lambda w, i: CASE WHEN i > 1 AND list_contains({_list(data.MINOR_WORDS)}, w) THEN w ELSE upper(w[1:1]) || w[2:] END), ' ') AS neat FROM (
 SELECT *, trim(regexp_replace(array_to_string(after_[:upto], ' '), '[.,!?;:]$', '')) AS span FROM (
 SELECT *, least(coalesce(list_position(list_transform(after_, lambda w: list_contains({stop}, lower(regexp_replace(w, '[.,!?;:''"]', '', 'g')))), true) - 1, 99),
   coalesce(list_position(list_transform(after_, lambda w: regexp_matches(w, '[.!?]$')), true), 99), len(after_)) AS upto FROM (
 SELECT {keys}, k, category, risk, safe, need, array_to_string(words[at_:at_ + n - 1], ' ') AS trig, words[at_ + n:at_ + n + {data.MAX_VALUE_WORDS - 1}] AS after_ FROM (
 SELECT {keys}, w_.words, h_.* EXCLUDE ({keys}) FROM (SELECT {keys}, k, phrase, n, category, risk, safe, need, min(i) AS at_ FROM (
  SELECT {keys}, sz, i, plain, length(plain) AS lp FROM (SELECT {keys}, sz, i, regexp_replace(lower(array_to_string(words[i:i + sz - 1], ' ')), '[^\\x00-\\x7F]', '?', 'g') AS plain FROM (
   SELECT {keys}, words, sz, unnest(range(1, len(words) - sz + 2)) AS i FROM (SELECT {keys}, string_split(text_nlp, ' ') AS words FROM {source}), (VALUES (1), (2), (3), (4), (5)) AS s_(sz) WHERE len(words) >= sz))) AS v_
  JOIN (VALUES {values}) AS t(k, phrase, n, category, risk, safe, need) ON v_.sz = t.n AND lp BETWEEN length(t.phrase) * 0.74 AND length(t.phrase) * 1.27
   AND 1.0::DOUBLE - levenshtein(plain, t.phrase)::DOUBLE / greatest(lp, length(t.phrase)) >= {data.FUZZY_THRESHOLD} GROUP BY ALL) AS h_
 JOIN (SELECT {keys}, string_split(text_nlp, ' ') AS words FROM {source}) AS w_ USING ({keys}))))))
WHERE span <> '' AND (need IS NULL OR regexp_matches(lower(span), need)) AND {ok}"""


def all_rows(source: str, keys: str, triggers: bool = True) -> str:
    parts = [rule_rows(r, source, keys, "text_regex") for r in rules.RULES] + [term_rows(source, keys)] + ([trigger_rows(source, keys)] if triggers else [])
    return "\nUNION ALL ".join(parts)


def rank(x: str) -> str:
    return f"(CASE {x} WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)"


def merged(source: str, keys: str, key: str = "lower(trim(raw_match))") -> str:
    return f"""SELECT * EXCLUDE (rn, ord), pos AS ord FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, {key} ORDER BY {rank('risk')} DESC, ord) AS rn,
 min(ord) OVER (PARTITION BY {keys}, {key}) AS pos FROM ({source})) WHERE rn = 1"""


def _in(ids) -> str:
    return "(" + ", ".join(f"'{i}'" for i in ids) + ")"


def base(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} IN {_in(ids)} THEN {score.SCORE[t]}" for t, ids in score.MEMBERS.items()) + " ELSE 0 END"


def scored(findings: str, docs: str, keys: str) -> str:
    """CTEs up to z: keys and the score's parts for all rows of docs; findings is a CTE's name."""
    crit, direct = score.MEMBERS["critical"], score.MEMBERS["direct"]
    ctx, box = score.MEMBERS["contextual"], score.MEMBERS["container"]
    lv = "['none', 'low', 'moderate', 'high']"
    return f"""ids AS (SELECT {keys}, sum(b)::INT AS base_total, count(*) FILTER (b > 0) AS types FROM (SELECT DISTINCT {keys}, pattern_id, {base('pattern_id')} AS b FROM {findings}) GROUP BY {keys}),
gov AS (SELECT {keys}, count(*) AS n_findings, bool_or(pattern_id IN {_in(crit)} AND coalesce(validated, false)) AS vc, bool_or(pattern_id IN {_in(crit + direct)}) AS dc,
 bool_or(pattern_id IN {_in(score.SENSITIVE)}) AS sc, bool_and(pattern_id IN {_in(ctx + box)}) AS co, bool_or(pattern_id IN {_in(ctx)}) AS cx FROM {findings} GROUP BY {keys}),
sc1 AS (SELECT d.*, coalesce(n_findings, 0) AS n_findings, coalesce(base_total, 0) AS base_total, CASE coalesce(types, 0) WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.2 WHEN 3 THEN 1.4 WHEN 4 THEN 1.7 ELSE 2.0 END::DOUBLE AS multiplier,
 CASE WHEN coalesce(types, 0) = 0 THEN 'none' WHEN vc THEN 'critical_entity' WHEN dc AND sc THEN 'sensitive_context' WHEN co AND cx THEN 'contextual_ceiling' ELSE 'none' END AS governance
 FROM {docs} d LEFT JOIN ids USING ({keys}) LEFT JOIN gov USING ({keys})),
sc2 AS (SELECT *, base_total * multiplier AS raw_, CASE WHEN base_total * multiplier >= 10 THEN 'high' WHEN base_total * multiplier >= 5 THEN 'moderate' WHEN base_total * multiplier >= 2 THEN 'low' ELSE 'none' END AS preliminary FROM sc1),
z AS (SELECT *, round(raw_, 2) AS score, {lv}[1 + CASE governance WHEN 'critical_entity' THEN 3 WHEN 'sensitive_context' THEN least({rank('preliminary')} + 1, 3)
 WHEN 'contextual_ceiling' THEN least({rank('preliminary')}, 2) ELSE {rank('preliminary')} END] AS risk_level FROM sc2)"""
