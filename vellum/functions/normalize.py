"""Text normalisation in three layers, as column expressions.

shared: compatibility composition, invisible characters out, line feeds, trimmed. regex layer: prose on one line with ASCII
punctuation, code blocks untouched. linguistic layer: one line of well-formed prose. Both guard against all-capitals text.

Two profiles: "documented" (default) recognises short capital labels as capitals followed by no letters and leaves inline code
where it stands; "as_written" takes capitals followed by no lower-case letters as a label and sets inline code on lines of its
own. Null texts count as empty.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from vellum.functions.dialect import SPACE_CHARACTERS, SPACES, java

# Character sets.
INVISIBLE = r"[\x{AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{206A}-\x{206F}\x{FEFF}]"
SINGLE_QUOTES, DOUBLE_QUOTES = "\u2018\u2019\u201A\u201B", "\u201C\u201D\u201E\u201F"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
EXOTIC_SPACES = "\u00A0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202F\u205F\u3000"
#: Marks of code blocks: on lines of their own, and in line.
BLOCK, END, INLINE, INLINE_END = "\uE000", "\uE001", "\uE002", "\uE003"
CODE = r"```[\s\S]*?```|`[^`\n]{10,}`"
LABEL = {"documented": r"^[A-Z]{1,4}[^A-Za-z]*$", "as_written": r"^[A-Z]{1,4}[^a-z]*$"}
#: A text is in capitals if it has more than so many characters, and more than this share of its letters are capitals.
CAPS_LENGTH, CAPS_SHARE = 10, 0.70
_CODE_JAVA = java(CODE)
#: White space other than a plain space.
_OTHER_SPACES = SPACES.replace(r"\s", r"\t\n\f\r")
#: Runs of white space but for single plain spaces, which collapsing leaves as they are; printing characters are told by one range. The same in ASCII.
_RUN = rf"(?![!-~])(?:[{_OTHER_SPACES}]| (?=[{SPACES}]))[{SPACES}]*"
_ASCII_RUN = r"[\t\n\x0B\f\r]\s*| \s+"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def _beyond_ascii(c: Column) -> Column:
    return F.octet_length(c) != F.length(c)


def compose(c: Column) -> Column:
    """NFKC. Spark has no such function; only texts beyond ASCII travel to Python, in Arrow batches."""
    return F.coalesce(_nfkc(F.when(_beyond_ascii(c), c)), c, F.lit(""))


def strip_invisible(c: Column) -> Column:
    return F.when(_beyond_ascii(c), F.regexp_replace(c, rf"(?![\x00-\x7F]){INVISIBLE}", "")).otherwise(c)


def line_feeds(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def trim_space(c: Column) -> Column:
    """From both ends only: a pattern would try every run of white space inside."""
    return F.btrim(c, F.lit(SPACE_CHARACTERS))


def shared_layer(c: Column) -> Column:
    return trim_space(line_feeds(strip_invisible(compose(c))))


def ascii_punctuation(c: Column) -> Column:
    """Typographic quotes, dashes and spaces to their ASCII forms."""
    source = SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + EXOTIC_SPACES
    target = "'" * 4 + '"' * 4 + "-" * 7 + " " * len(EXOTIC_SPACES)
    return F.when(_beyond_ascii(c), F.translate(c, source, target)).otherwise(c)


def collapse(c: Column) -> Column:
    return F.trim(F.when(_beyond_ascii(c), F.regexp_replace(c, _RUN, " ")).otherwise(F.regexp_replace(c, _ASCII_RUN, " ")))


def upper_ratio(c: Column) -> Column:
    """Share of capitals among ASCII letters, 0 without letters. Letters are taken out by runs, since each match costs as much as many characters."""
    letters = _count(c, "a-zA-Z")
    return F.when(letters > 0, _count(c, "A-Z") / letters).otherwise(F.lit(0.0))


def caps_ratio(c: Column) -> Column:
    """``upper_ratio`` if it may be above ``CAPS_SHARE``, else 0: not if the letters of the first eighth alone are too many for all capitals."""
    head = _count(F.left(c, (F.length(c) / 8).cast("int")), "a-zA-Z")
    return F.when(_count(c, "A-Z") >= head * (CAPS_SHARE * 0.9), upper_ratio(c)).otherwise(F.lit(0.0))


def _count(c: Column, letters: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, f"[{letters}]+", ""))


def _capitals(parts: Column) -> Column:
    """Parts joined, each with its first letter (a-z) raised."""
    first = lambda p: F.substring(p, 1, 1)
    return F.array_join(F.transform(parts, lambda p: F.when(first(p).rlike("[a-z]"), F.concat(F.upper(first(p)), F.substr(p, F.lit(2)))).otherwise(p)), "")


#: Places before a letter that follows a sentence's end; white space is single by then.
_SENTENCE = r"(?<=[.!?] )(?=[a-z])"


def sentence_case(c: Column) -> Column:
    """Lower case, with capitals at the start and after sentences, and for the word I."""
    return F.regexp_replace(_capitals(F.split(F.lower(c), _SENTENCE, -1)), java(r"\bi\b"), "I")


def caps_fires(c: Column, profile: str = "documented", ratio: Column | None = None) -> Column:
    """ratio: the text's ``caps_ratio``, if it is known."""
    return (F.length(c) > CAPS_LENGTH) & ((caps_ratio(c) if ratio is None else ratio) > CAPS_SHARE) & ~F.trim(c).rlike(LABEL[profile].replace("$", r"\z"))


def code_blocks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_CODE_JAVA), F.lit(0))


def split_code(c: Column, codes: Column, profile: str) -> Column:
    """Prose with a mark for each code block, before collapsing. codes: the blocks, as a column of their own."""
    wide = lambda k: F.concat(F.lit("\n" + BLOCK), k.cast("string"), F.lit(END + "\n"))
    mark = lambda b, k: wide(k)
    if profile == "documented":
        mark = lambda b, k: F.when(b.startswith("```"), wide(k)).otherwise(F.concat(F.lit(INLINE), k.cast("string"), F.lit(INLINE_END)))
    marks = F.transform(codes, mark)
    return F.array_join(F.zip_with(F.split(c, _CODE_JAVA, -1), marks, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")


def prose_parts(prose: Column) -> Column:
    """Prose cut at the marks of code blocks."""
    return F.split(prose, f"{BLOCK}[0-9]+{END}|{INLINE}[0-9]+{INLINE_END}", -1)


def join_code(parts: Column, codes: Column, profile: str) -> Column:
    """Code blocks back between the parts of prose, fenced ones on lines of their own; runs of line feeds cut to two.

    parts and codes: columns of their own, since every step of the functions below reads them, and would work an expression out anew.
    """
    lines = lambda b: F.concat(F.lit("\n"), b, F.lit("\n"))
    fenced = (lambda b: b.startswith("```")) if profile == "documented" else (lambda b: F.lit(True))
    n = F.size(parts)
    alone = lambda i: F.coalesce(fenced(F.get(codes, i)), F.lit(False))  # noqa: E731  has lines of its own
    end = lambda p, i: F.when((i < n - 1) & alone(i) & p.endswith(" "), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)
    start = lambda p, i: F.when((i > 0) & alone(i - 1) & p.startswith(" "), F.substr(p, F.lit(2))).otherwise(p)
    trimmed = F.transform(F.transform(parts, end), start)  # one space on either side of such a block goes
    put = lambda p, b: F.concat(p, F.coalesce(F.when(fenced(b), lines(b)).otherwise(b), F.lit("")))
    return trim_space(F.regexp_replace(F.array_join(F.zip_with(trimmed, codes, put), ""), "\n{3,}", "\n\n"))


def tidy_punctuation(c: Column) -> Column:
    """Runs of one sentence mark to one, none after a space, a space before a following letter, one space after commas."""
    out = F.regexp_replace(c, r"([.!?])\1+", "$1")
    out = F.regexp_replace(out, " ([,;:!?.])", "$1")
    out = F.regexp_replace(out, "([,;:!?.])([a-zA-Z])", "$1 $2")
    return F.regexp_replace(out, f",[{SPACES}]+", ", ")


def sentence_bounds(c: Column) -> Column:
    """A full stop between a lower-case letter and a capitalised word of three letters or more."""
    # searched from the space on; the letter before it must not belong to the last match, which a match from that letter on would need too
    return F.regexp_replace(c, r" (?<=[a-z] )(?<!\G )([A-Z][a-z]{2,})", ". $1")


def raise_starts(c: Column) -> Column:
    """Capitals at the start, after quotes and brackets too, and after sentences."""
    lead = r"^([\"'(\[{]*)[a-z]"
    n = F.length(F.regexp_extract(c, lead, 1))
    start = F.when(c.rlike(lead), F.concat(F.substring(c, F.lit(1), n), F.upper(F.substring(c, n + 1, F.lit(1))), F.substr(c, n + 2))).otherwise(c)
    raised = F.transform(F.split(start, _SENTENCE, -1), lambda p, i: F.when((i > 0) & F.substring(p, 1, 1).rlike("[a-z]"), F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))).otherwise(p))
    return F.when(c.rlike("[.!?] [a-z]"), F.array_join(raised, "")).otherwise(start)


def normalize(df: DataFrame, text_col: str = "text", profile: str = "documented") -> DataFrame:
    """Add masked, text_regex, text_nlp and was_caps_converted; steps are columns of their own, so none is worked out twice."""
    has_code = F.col("masked").contains("`")
    d = df.withColumn("masked", shared_layer(F.col(text_col)))
    d = d.withColumn("codes__", F.when(has_code, code_blocks(F.col("masked"))))
    d = d.withColumns({"flat__": collapse(ascii_punctuation(F.col("masked"))), "split__": F.when(has_code, split_code(F.col("masked"), F.col("codes__"), profile))})
    d = d.withColumn("ratio__", caps_ratio(F.col("flat__")))
    d = d.withColumn("prose__", F.when(has_code, collapse(ascii_punctuation(F.col("split__")))).otherwise(F.col("flat__")))
    # tidying and sentence bounds change no letter, so the share of capitals stays
    d = d.withColumn("nlp__", sentence_bounds(tidy_punctuation(F.col("flat__"))))
    ratio_r = F.when(has_code, caps_ratio(F.col("prose__"))).otherwise(F.col("ratio__"))
    d = d.withColumn("caps_r__", caps_fires(F.col("prose__"), profile, ratio_r)).withColumn("caps_n__", caps_fires(F.col("nlp__"), profile, F.col("ratio__")))
    d = d.withColumn("prose__", F.when(F.col("caps_r__"), sentence_case(F.col("prose__"))).otherwise(F.col("prose__")))
    d = d.withColumn("nlp__", F.when(F.col("caps_n__"), sentence_case(F.col("nlp__"))).otherwise(F.col("nlp__")))
    plain = trim_space(F.col("prose__"))  # one line
    d = d.withColumn("parts__", F.when(has_code, prose_parts(F.col("prose__"))))
    d = d.withColumn("text_regex", F.when(has_code, join_code(F.col("parts__"), F.col("codes__"), profile)).otherwise(plain))
    d = d.withColumn("text_nlp", raise_starts(F.col("nlp__")))
    return d.withColumn("was_caps_converted", F.col("caps_r__") | F.col("caps_n__")).drop("flat__", "split__", "ratio__", "prose__", "nlp__", "caps_r__", "caps_n__", "codes__", "parts__")


def legacy(c: Column) -> Column:
    """The older single-layer form: NFC, plain quotes and dashes, spaces collapsed but line feeds kept."""
    out = F.coalesce(_nfc(F.when(_beyond_ascii(c), c)), c, F.lit(""))
    out = F.translate(out, "\u2018\u2019\u201C\u201D\u2013\u2014", "''\"\"--")
    return trim_space(F.regexp_replace(out, f"[{SPACES.replace(chr(92) + 's', ' ' + chr(92) + 't' + chr(92) + 'f' + chr(92) + 'r')}]+", " "))
