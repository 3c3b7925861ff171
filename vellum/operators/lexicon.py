"""Lexicon path: known terms, and values that follow trigger phrases matched with tolerance for typing errors."""

from __future__ import annotations

from functools import cache, lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from vellum.functions import validators
from vellum.functions.dialect import any_of
from vellum.operators import lexicon_data as data
from vellum.operators.rules import FINDING, STEP, finding

_STOP = data.STOP_WORDS
#: ASCII word edges around a term; terms begin and end with letters.
_FROM, _TO = "(?i)(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def term_findings(text: Column) -> Column:
    """The first hit of each term, in the terms' order. One search tells whether any term stands in the text, then one for each category."""
    parts, order, none = [], 200 * STEP, F.array().cast(f"array<{FINDING}>")
    for category, terms in data.TERMS.items():
        label, safe = data.TERM_LABEL.get(category, (None, "[REDACTED]"))
        before, _, after = safe.partition("{}")

        def made(hit: Column) -> Column:
            out = F.concat(F.lit(before), hit["raw"], F.lit(after)) if "{}" in safe else F.lit(safe)
            return finding(f"gazetteer_{category}", label or hit["term"], data.TERM_RISK[category], hit["raw"], out, None, "B1_gazetteer", hit["k"] + order)

        first = lambda t, k: F.struct(t.alias("term"), F.call_function("regexp_extract", text, F.concat(F.lit(_FROM), t, F.lit(_TO)), F.lit(0)).alias("raw"), k.alias("k"))
        hits = F.filter(F.transform(strings(terms), first), lambda h: h["raw"] != "")
        found = F.transform(hits, made).cast(f"array<{FINDING}>")
        parts.append(F.when(_holds(text, terms), found).otherwise(none))
        order += len(terms)
    return F.when(_holds(text, [t for terms in data.TERMS.values() for t in terms]), F.concat(*parts)).otherwise(F.when(text.isNotNull(), none))


def _holds(text: Column, terms: list[str]) -> Column:
    """Whether any of the terms stands in the text. The character before a term is matched, not looked back at, so one stands before the text too."""
    return F.concat(F.lit(" "), text).rlike("(?i)[^A-Za-z0-9_]" + any_of(terms) + _TO)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 if both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, F.lit(1.0) - F.levenshtein(a, b) / longer).otherwise(F.lit(1.0))


def _near(phrase: str) -> str:
    """SQL test of a window w for being similar enough to the phrase.

    Within the threshold lengths differ by at most a fifth of the longer, so others are not compared; and no more edits are
    counted than the longest such window may have. SQL text, since dozens of such tests are slow to build call by call.
    """
    low, high = _lengths([phrase])
    edits = f"levenshtein(w, {_quote(phrase)}, {high // 5})"
    return f"(length(w) between {low} and {high} and {edits} >= 0 and 1D - {edits} / greatest(length(w), {len(phrase)}) >= {data.FUZZY_THRESHOLD}D)"


def _lengths(phrases: list[str]) -> tuple[int, int]:
    """Least and greatest length of what may be similar to one of the phrases."""
    return min(-(-len(p) * 4 // 5) for p in phrases), max(len(p) * 5 // 4 for p in phrases)


def _quote(text: str | None) -> str:
    return "null" if text is None else "'" + text.replace("'", "\\'") + "'"


def strings(words) -> Column:
    """A literal array."""
    return F.expr("array(" + ", ".join(map(_quote, dict.fromkeys(words))) + ")")


def _window(words: str, n: int, test: str) -> str:
    """SQL test of the n words from place i on, joined by spaces; the joined text is named w in it and held for one place at a time."""
    return f"exists(array(array_join(slice({words}, i + 1, {n}), ' ')), w -> {test})"


def near_places(words: str, n: int, among: str | None = None) -> str:
    """SQL of the places from which n words are similar to any phrase of n words, in order. among: an array that holds them all, in order.

    Their lengths are summed first, so that few windows are put together; only places are kept, so that a long text needs no more
    room than its words.
    """
    phrases = [p for p, *_ in data.TRIGGERS if p.count(" ") + 1 == n]
    low, high = _lengths(phrases)
    length = " + ".join(f"length(get({words}, i + {k}))" for k in range(n)) + f" + {n - 1}"
    any_of = " or ".join(map(_near, phrases))
    places = f"filter({among or f'sequence(0, size({words}) - {n})'}, i -> {length} between {low} and {high} and {_window(words, n, any_of)})"
    return f"case when size({words}) >= {n} then {places} else cast(array() as array<int>) end"


def first_place(places: str, words: str, phrase: str) -> str:
    """SQL of the first of the places from which words are similar to the phrase, null if there is none."""
    return f"get(filter({places}, i -> {_window(words, phrase.count(' ') + 1, _near(phrase))}), 0)"


#: Numbers of words that phrases have.
SIZES = sorted({p.count(" ") + 1 for p, *_ in data.TRIGGERS})


def cut(text: str, n: int) -> list[int]:
    """Where to cut a text into n pieces so that few texts hold one: even ones, of which none is a common word by itself."""
    rare = lambda a, b: 0.25 ** text.count(" ", a, b) * 0.07 ** (b - a - text.count(" ", a, b)) + 0.003 * (text[a:b].strip() in _STOP)
    best = {(0, 0): (0.0, [0])}
    for k in range(1, n + 1):
        for b in range(k, len(text) + 1):
            best[k, b] = min((best[k - 1, a][0] + rare(a, b), [*best[k - 1, a][1], b]) for a in range(b) if (k - 1, a) in best)
    return best[n, len(text)][1]


@cache
def _pieces() -> ahocorasick.Automaton:
    """All phrases cut into pieces, one more than a window similar to the phrase may have edits.

    Then the window holds a piece as it is, before which there are just as many edits as pieces: count edits less pieces from the left, and the
    first sum below 0 is that behind such a piece. So the k-th piece has moved by k at most, and what follows it has the rest of the edits.
    A piece's values: the phrase, its words and length, the least and greatest length of a window, how many characters the space before
    the phrase stands before the piece's end, the edits before it and those after it.
    """
    found: dict[str, list[tuple]] = {}
    for p in dict.fromkeys(p for p, *_ in data.TRIGGERS):
        low, high = _lengths([p])
        most, edged = high // 5, f" {p} "
        cuts = cut(edged, most + 1)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            found.setdefault(edged[a:b], []).append((p, p.count(" ") + 1, len(p), low, high, b - 1, k, most - k))
    automaton = ahocorasick.Automaton()
    for piece, values in found.items():
        automaton.add_word(piece, values)
    automaton.make_automaton()
    return automaton


@cache
def _masks(phrase: str) -> dict[str, int]:
    """For each letter of the phrase the bits of its places."""
    return {c: sum(1 << k for k, x in enumerate(phrase) if x == c) for c in phrase}


def near(window: str, phrase: str) -> bool:
    """What ``_near`` is in SQL. Each letter that only one of both has is an edit of its own there, which most windows have too many of."""
    most, there, wanted = max(len(window), len(phrase)) // 5, {*window}, _masks(phrase).keys()
    return len(there - wanted) <= most and len(wanted - there) <= most and edits(window, phrase) <= most


@lru_cache(1 << 14)
def edits(window: str, phrase: str) -> int:
    """Edit distance by Myers' algorithm: a column of the table of edits is held in the bits of two numbers."""
    masks, last = _masks(phrase), 1 << len(phrase) - 1
    full = (last << 1) - 1
    up, down, count = full, 0, len(phrase)
    for c in window:
        same = masks.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        right, left = down | ~(across | up), up & across
        count += (right & last != 0) - (left & last != 0)
        right, left = right << 1 | 1, left << 1
        same |= down
        up, down = (left | ~(same | right)) & full, right & same & full
    return count


def candidates(text: str) -> list[list[int]] | None:
    """For each of ``SIZES`` the places, counted in words, from which so many words are similar to a phrase; None if there are none."""
    edged, at = f" {text} ", [set() for _ in SIZES]
    for end, values in _pieces().iter(edged):
        for phrase, n, size, low, high, back, before, after in values:
            kept, start = at[n - SIZES[0]], end - back
            a = edged.find(" ", max(start - before, 0), start + before + 1)
            while a >= 0:
                if a not in kept:
                    b = a
                    for _ in range(n):
                        b = edged.find(" ", b + 1, a + high + 2)
                        if b < 0:
                            break
                    if low < b - a <= high + 1 and -after <= b - start - 1 - size <= after and near(edged[a + 1 : b], phrase):
                        kept.add(a)
                a = edged.find(" ", a + 1, start + before + 1)
    if not any(at):
        return None
    words, word, last = {}, 0, 0
    for a in sorted(set().union(*at)):
        word += edged.count(" ", last, a)
        words[a], last = word, a
    return [sorted(words[a] for a in kept) for kept in at]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _candidates(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else candidates(t) for t in text], dtype=object)


def _bare(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, "[.,!?;:'\"]", ""))


def value_words(words: Column, start: Column) -> Column:
    """Up to eight words from start, before a stop word, through a word that ends a sentence."""
    after = F.slice(words, start + 1, F.lit(data.MAX_VALUE_WORDS))
    stops = strings(_STOP)
    stop = F.array_position(F.transform(after, lambda w: F.array_contains(stops, _bare(w))), True)
    end = F.array_position(F.transform(after, lambda w: w.rlike(r"[.!?]\z")), True)
    upto = F.least(F.when(stop > 0, stop - 1), F.when(end > 0, end), F.size(after))
    return F.slice(after, F.lit(1), upto.cast("int"))


def span_of(words: Column) -> Column:
    return F.trim(F.regexp_replace(F.array_join(words, " "), r"[.,!?;:]\z", ""))


def recapitalise(span: Column) -> Column:
    """Every word capitalised but minor words that do not come first."""
    up = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    return F.array_join(F.transform(F.split(F.lower(span), " "), lambda w, i: F.when((i > 0) & w.isin(data.MINOR_WORDS), w).otherwise(up(w))), " ")


def plausible(span: Column, category: Column) -> Column:
    """Whether a value looks like one of its category."""
    words = F.filter(F.split(F.lower(span), " "), lambda w: w != "")
    digit, holds = span.rlike("[0-9]"), lambda terms: F.lower(span).rlike("|".join(terms))
    of_kind = (
        F.when(category == "person_name", ~span.rlike("^[0-9]"))
        .when(category == "age", span.rlike("^[0-9]"))
        .when(category == "dob", digit)
        .when(category == "location", validators.has_place(span) | F.exists(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(strings(_STOP), w)))
        .when(category == "health", holds(data.TERMS["medical"]))
        .when(category == "religion", holds(data.TERMS["nationality_religion"]))
        .when(category == "financial", digit | holds(data.TERMS["financial"]))
        .otherwise(True)
    )
    return (F.length(span) >= 2) & F.exists(words, lambda w: ~F.array_contains(strings(_STOP), w)) & of_kind


def trigger_finding(words: Column, hit: Column) -> Column:
    """The finding of one hit (k, n, category, risk, needs, at); null if its value does not hold."""
    label, safe = F.lit(None), F.lit(None)
    for category, (name, text) in data.CATEGORY.items():
        label = F.when(hit["category"] == category, name).otherwise(label)
        safe = F.when(hit["category"] == category, F.lit(text)).otherwise(safe)

    def made(x: Column) -> Column:
        ok = (x["span"] != "") & plausible(x["neat"], hit["category"]) & (hit["needs"].isNull() | F.call_function("rlike", F.lower(x["span"]), hit["needs"]))
        value = F.coalesce(safe, F.concat(F.substring(x["neat"], 1, 1), F.lit("***")))
        raw, safe_version = F.concat_ws(" ", x["trigger"], x["span"]), F.concat_ws(" ", x["trigger"], value)
        return F.when(ok, finding(F.concat(F.lit("trigger_"), hit["category"]), label, hit["risk"], raw, safe_version, None, "B2_trigger", hit["k"] + 300 * STEP))

    # one step of transform binds a value, which is then read many times
    bind = lambda value, use: F.get(F.transform(F.array(value), use), 0)
    trigger = F.array_join(F.slice(words, hit["at"] + 1, hit["n"]), " ")
    with_neat = lambda s: F.struct(s.alias("span"), recapitalise(s).alias("neat"), trigger.alias("trigger"))
    return bind(bind(span_of(value_words(words, hit["at"] + hit["n"])), with_neat), made)


def with_trigger_findings(df: DataFrame, nlp_col: str = "text_nlp", out: str = "triggers") -> DataFrame:
    """Add the array of trigger findings. Words and places of windows are columns of their own.

    Places that may be similar to a phrase are found in Python by pieces of the phrases, in one search of the text; only those are held
    against the phrases here. A generator of one row stands before the Python function, as in ``redact.with_safe_text``.
    """
    d = df.withColumn("one__", F.explode(F.array(F.lit(0)))).withColumn("low__", F.lower(nlp_col)).withColumn("near__", _candidates("low__"))
    some = F.col("near__").isNotNull()
    d = d.withColumns({"words__": F.when(some, F.filter(F.split(F.col(nlp_col), " "), lambda w: w != "")), "lower__": F.when(some, F.split("low__", " "))})
    d = d.withColumns({f"at{n}__": F.expr(f"case when near__ is not null then {near_places('lower__', n, f'near__[{k}]')} end") for k, n in enumerate(SIZES)})
    hits = ", ".join(
        f"named_struct('k', {k}, 'n', {p.count(' ') + 1}, 'category', {_quote(c)}, 'risk', {_quote(r)}, 'needs', cast({_quote('|'.join(data.TERMS[need]) if need else None)} as string), "
        f"'at', {first_place(f'at{p.count(chr(32)) + 1}__', 'lower__', p)})"
        for k, (p, c, r, need) in enumerate(data.TRIGGERS)
    )
    none = "cast(array() as array<struct<k:int,n:int,category:string,risk:string,needs:string,at:int>>)"
    any_window = " or ".join(f"size(at{n}__) > 0" for n in SIZES)
    d = d.withColumn("at__", F.expr(f"case when {any_window} then filter(array({hits}), h -> h.at is not null) else {none} end"))
    found = F.filter(F.transform("at__", lambda h: trigger_finding(F.col("words__"), h)), lambda f: f.isNotNull())
    return d.withColumn(out, found.cast(f"array<{FINDING}>")).drop("one__", "words__", "low__", "near__", "lower__", "at__", *[f"at{n}__" for n in SIZES])
