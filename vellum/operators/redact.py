"""Safe texts and display forms."""

from __future__ import annotations

import bisect
import heapq
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Up to so many findings the replacements are folded over the text inside the JVM; with more, occurrences are indexed.
FOLDED = 64


def in_order(findings: Column) -> Column:
    """Findings by length of their match, longest first, then by place."""
    order = lambda a, b: F.when(F.length(a["raw_match"]) != F.length(b["raw_match"]), F.length(b["raw_match"]) - F.length(a["raw_match"])).otherwise(F.signum(a["ord"] - b["ord"]).cast("int"))
    return F.array_sort(findings, order)


def safe_text(text: Column, findings: Column) -> Column:
    """All literal occurrences of the findings' matches replaced, longest match first, each in what the last left; each goes through the whole text."""
    swap = lambda acc, f: F.when(f["raw_match"] != "", F.replace(acc, f["raw_match"], f["safe_version"])).otherwise(acc)
    return F.aggregate(in_order(findings), F.coalesce(text, F.lit("")), swap)


class Replay:
    """Literal replacements one after another, each of all occurrences in what the last left, without going through the text each time.

    All matches' occurrences are found once. A replacement turns a stretch of the text into a piece, which takes in the pieces that it
    touches; only around a piece, within the longest match's reach, can there be occurrences that the text did not have, and there they
    are searched anew. A place is a pair: a place of the text, and one in the piece that begins there.
    """

    def __init__(self, text: str, swaps: list[tuple[str, str]]):
        self.text, self.swaps = text, [s for s in swaps if s[0]]
        self.starts: list[int] = []
        self.pieces: dict[int, tuple[int, str]] = {}  # start: end, what stands there now
        self.by_match: dict[str, list[int]] = defaultdict(list)
        for k, (match, _) in enumerate(self.swaps):
            self.by_match[match].append(k)
        self.reach = max(map(len, self.by_match), default=0)

    def run(self) -> str:
        if not self.swaps:
            return self.text
        self.automaton = ahocorasick.Automaton()
        for match in self.by_match:
            self.automaton.add_word(match, match)
        self.automaton.make_automaton()
        self.found = defaultdict(list)
        for end, match in self.automaton.iter(self.text):
            self.found[match].append(end + 1 - len(match))
        due = [k for match in self.found for k in self.by_match[match]]
        heapq.heapify(due)
        self.due, self.near, last = due, defaultdict(set), -1
        while due:
            k = heapq.heappop(due)
            if k > last:
                self._replace(k)
                last = k
        return self._joined()

    def _inside(self, start: int, end: int) -> bool:
        """Whether a stretch of the text touches a piece."""
        at = bisect.bisect_left(self.starts, end) - 1
        return at >= 0 and self.pieces[self.starts[at]][0] > start

    def _replace(self, k: int) -> None:
        match, safe = self.swaps[k]
        n = len(match)
        at = [((p, 0), (p + n, 0)) for p in self.found.get(match, ()) if not self._inside(p, p + n)]
        for start in list(self.near.pop(k, ())):
            if start in self.pieces:
                at += self._around(start, match)
        taken, end = [], (-1, 0)
        for low, high in sorted(set(at)):
            if low >= end:
                taken.append((low, high))
                end = high
        for low, high in reversed(taken):  # places to the left of a replacement stay as they are
            self._put(low, high, safe, k)

    def _context(self, start: int) -> tuple[str, list[tuple[int, int]], int, int]:
        """A piece with the longest match's reach on either side: the characters, their places and where the piece lies."""
        stop, piece = self.pieces[start]
        left, at, room = [], start, self.reach - 1
        i = bisect.bisect_left(self.starts, start) - 1
        while room > 0 and at > 0:
            low = self.starts[i] if i >= 0 else -1
            if i >= 0 and self.pieces[low][0] == at:
                body = self.pieces[low][1]
                part = [(body[o], (low, o)) for o in range(max(0, len(body) - room), len(body))]
                at, i = low, i - 1
            else:
                to = max(at - room, self.pieces[low][0] if i >= 0 else 0)
                part = [(self.text[p], (p, 0)) for p in range(to, at)]
                at = to
            left = part + left
            room -= len(part)
        right, at, room = [], stop, self.reach - 1
        i = bisect.bisect_right(self.starts, start)
        while room > 0 and (at < len(self.text) or i < len(self.starts)):
            if i < len(self.starts) and self.starts[i] == at:
                end, body = self.pieces[at]
                part = [(c, (at, o)) for o, c in enumerate(body[:room])]
                at, i = end, i + 1
            else:
                to = min(at + room, self.starts[i] if i < len(self.starts) else len(self.text))
                part = [(self.text[p], (p, 0)) for p in range(at, to)]
                at = to
            right += part
            room -= len(part)
        all_of = left + [(c, (start, o)) for o, c in enumerate(piece)] + right
        return "".join(c for c, _ in all_of), [p for _, p in all_of], len(left), len(left) + len(piece)

    def _around(self, start: int, match: str) -> Iterator[tuple]:
        """Occurrences of a match that touch a piece, as places."""
        shown, places, low, high = self._context(start)
        at = shown.find(match)
        while at >= 0:
            end = at + len(match)
            # an empty piece is touched by what stands on both of its sides
            if at < high and end > low or low == high and at < low < end:
                yield places[at], self._after(places[end - 1])
            at = shown.find(match, at + 1)

    def _after(self, place: tuple[int, int]) -> tuple[int, int]:
        """The place behind a character."""
        p, o = place
        if p not in self.pieces:
            return p + 1, 0
        stop, piece = self.pieces[p]
        return (p, o + 1) if o + 1 < len(piece) else (stop, 0)

    def _put(self, low: tuple[int, int], high: tuple[int, int], safe: str, k: int) -> None:
        (a, i), (b, j) = low, high
        first = self.pieces[a][1][:i] if a in self.pieces else ""
        rest = self.pieces[b][1][j:] if j else ""
        stop = self.pieces[b][0] if j else b
        x, y = bisect.bisect_left(self.starts, a), bisect.bisect_left(self.starts, stop)
        for p in self.starts[x:y]:
            del self.pieces[p]
        self.starts[x:y] = [a]
        self.pieces[a] = (stop, first + safe + rest)
        shown, _, begin, end = self._context(a)
        for e, match in self.automaton.iter(shown):
            s = e + 1 - len(match)
            if s < end and e + 1 > begin or begin == end and s < begin < e + 1:
                for later in self.by_match[match]:
                    if later > k:
                        self.near[later].add(a)
                        heapq.heappush(self.due, later)

    def _joined(self) -> str:
        out, at = [], 0
        for p in self.starts:
            end, piece = self.pieces[p]
            out += [self.text[at:p], piece]
            at = end
        return "".join([*out, self.text[at:]])


@F.pandas_udf(T.StringType())
def _replayed(text: pd.Series, raw: pd.Series, safe: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else Replay(t, list(zip(r, s, strict=True))).run() for t, r, s in zip(text, raw, safe, strict=True)], dtype=object)


def with_safe_text(df: DataFrame, text_col: str = "text", findings_col: str = "findings", out: str = "safe_text") -> DataFrame:
    """``df`` and its safe texts. Rows of over ``FOLDED`` findings, and only those, travel to Python, where their texts are gone through once.

    A generator of one row stands before the Python function: it keeps Spark from working the projections below into those that read the
    function, which the optimizer tries at great length and which would work the findings out several times.
    """
    many = F.size(findings_col) > FOLDED
    field = lambda name: F.when(many, F.transform("order__", lambda f: f[name]))
    d = df.withColumn("one__", F.explode(F.array(F.lit(0)))).withColumn("order__", F.when(many, in_order(F.col(findings_col))))
    d = d.withColumns({"raw__": field("raw_match"), "safe__": field("safe_version"), "long__": F.when(many, F.coalesce(F.col(text_col), F.lit("")))})
    d = d.withColumn("replayed__", _replayed("long__", "raw__", "safe__"))
    folded = safe_text(F.col(text_col), F.when(~many, F.col(findings_col)))
    return d.withColumn(out, F.when(many, F.col("replayed__")).otherwise(folded)).drop("one__", "order__", "raw__", "safe__", "long__", "replayed__")


def truncate(text: Column, most: int = 60) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
