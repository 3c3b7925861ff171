"""One regex source for two engines: patterns with ASCII word edges and Unicode white space, for Java and for RE2."""

from __future__ import annotations

#: White space beyond what Java's and RE2's \s share, as it stands inside a bracket class.
SPACES = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same characters themselves.
SPACE_CHARACTERS = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Any character but a line end.
NOT_LINE_END = r"[^\n\r\x{2028}\x{2029}]"
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _expand(pattern: str, edge: str) -> str:
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\":
            if two == r"\s":
                out.append(SPACES if inside else f"[{SPACES}]")
            elif two == r"\b" and not inside:
                out.append(edge)
            else:
                out.append(two)
            i += 2
            continue
        if two[0] == "[" and not inside:
            inside = True
        elif two[0] == "]":
            inside = False
        elif two[0] == "." and not inside:
            out.append(NOT_LINE_END)
            i += 1
            continue
        out.append(two[0])
        i += 1
    return "".join(out)


def java(pattern: str) -> str:
    """For Spark: \\b sees ASCII word characters only, \\s all white space, . no line end."""
    return _expand(pattern, _EDGE)


def re2(pattern: str) -> str:
    """For RE2, whose own \\b is the ASCII one; lookarounds are not available there."""
    return _expand(pattern, r"\b")


def any_of(words) -> str:
    """A pattern of some plain words with their common beginnings written once, so that a place of the text is tried against one letter a branch instead of against every word.

    It finds where any of the words begins; of words that begin alike it matches the longest.
    """

    def branch(rest: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for w in rest:
            if w:
                heads.setdefault(w[0], []).append(w[1:])
        parts = [_plain(c) + branch(sorted(set(tails))) for c, tails in heads.items()]
        if not parts:
            return ""
        joined = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
        return joined if "" not in rest else f"(?:{joined})?"

    return branch(sorted(set(words)))


def _plain(c: str) -> str:
    return c if c.isalnum() or c in " '" else f"[{c}]" if c not in "^]\\" else f"\\{c}"


def sql_string(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
