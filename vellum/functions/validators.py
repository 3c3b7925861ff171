"""Predicates that accept or reject a rule's match, as column expressions.

mode "strict" checks cards by Luhn and e-mail by structure; "fast" takes those two as matched. A rule without a predicate, and
what "fast" takes as matched, is not validated there; everything kept is in "strict".
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vellum.functions.dialect import any_of
from vellum.operators.lexicon_data import PLACES, SHORTEST_PLACES

# Structural forms, the same in Java and RE2.
EMAIL = r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"
JWT = r"eyJ[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+"
IPV4 = r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
IPV6 = r"(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}:"
MAC = r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}"


def digits_only(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def clean(m: Column) -> Column:
    """Spaces, then one quote or backtick on each side, then spaces off."""
    return F.trim(F.regexp_replace(F.trim(m), "^[\"'`]|[\"'`]\\z", ""))


def _full(m: Column, pattern: str) -> Column:
    return clean(m).rlike(rf"\A(?:{pattern})\z")


def is_card(m: Column) -> Column:
    d = digits_only(m)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def is_email(m: Column) -> Column:
    """Well formed, with at most 64 characters before the sign and 254 after it; longer ones never reach the pattern."""
    local, domain = F.substring_index(clean(m), "@", 1), F.substring_index(clean(m), "@", -1)
    return F.when((F.length(local) <= 64) & (F.length(domain) <= 254), _full(m, EMAIL)).otherwise(False)


def is_jwt(m: Column) -> Column:
    return _full(m, JWT)


def is_mobile_ph(m: Column) -> Column:
    """Eleven digits that start with 09 once a leading 63 has become 0."""
    d = digits_only(m)
    d = F.when(d.startswith("63"), F.concat(F.lit("0"), F.substr(d, F.lit(3)))).otherwise(d)
    return (F.length(d) == 11) & d.startswith("09")


def is_mobile(m: Column) -> Column:
    return F.regexp_replace(m, r"[\s()+.-]", "").rlike(r"\A[0-9]{7,15}\z")


def is_ipv4(m: Column) -> Column:
    return _full(m, IPV4)


def is_ipv6(m: Column) -> Column:
    return _full(m, IPV6)


def is_mac(m: Column) -> Column:
    return _full(m, MAC)


def has_place(m: Column) -> Column:
    """Whether a place name stands anywhere in the text, inside words too."""
    return F.lower(m).rlike(any_of(SHORTEST_PLACES))


def places(m: Column) -> Column:
    """All place names in the text, longest first."""
    names = F.array(*map(F.lit, PLACES))
    return F.when(has_place(m), F.filter(names, lambda p: F.contains(F.lower(m), p))).otherwise(F.when(m.isNotNull(), F.array().cast("array<string>")))


PREDICATES = {
    "card": is_card,
    "email": is_email,
    "jwt": is_jwt,
    "mobile_ph": is_mobile_ph,
    "mobile": is_mobile,
    "ipv4": is_ipv4,
    "ipv6": is_ipv6,
    "mac": is_mac,
    "address": has_place,
}
#: Predicates that "fast" mode takes as matched.
UNCHECKED_WHEN_FAST = frozenset({"card", "email"})


def passes(name: str | None, m: Column, mode: str = "strict") -> Column:
    """Whether a match is kept; a rule whose predicate is not known keeps all its matches."""
    if name not in PREDICATES or mode == "fast" and name in UNCHECKED_WHEN_FAST:
        return F.lit(True)
    return PREDICATES[name](m)


def validated(name: str | None, mode: str = "strict") -> bool:
    return mode == "strict" or name is not None and name not in UNCHECKED_WHEN_FAST
