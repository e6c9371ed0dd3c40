"""Pieces of DuckDB SQL for the rules of the operators: patterns, ordered rules, cut and distinct lists."""

from __future__ import annotations

from .adapters import SPACES, cleaned

__all__ = ["all_rules", "cleaned", "count", "cut", "decoded", "distinct", "distinct_ci", "first_rule", "half_up", "hits", "listed", "lookup", "quoted", "slug", "trimmed"]


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pattern(p: str, ignore_case: bool = True) -> str:
    return quoted(("(?i)" if ignore_case else "") + p)


def hits(text: str, p: str, ignore_case: bool = True) -> str:
    return f"regexp_matches({text}, {pattern(p, ignore_case)})"


def count(text: str, p: str, ignore_case: bool = True) -> str:
    return f"len(regexp_extract_all({text}, {pattern(p, ignore_case)}))"


def first_rule(text: str, rules, otherwise: str) -> str:
    return "case " + " ".join(f"when {hits(text, p)} then {quoted(label)}" for label, p in rules) + f" else {otherwise} end"


def all_rules(text: str, rules) -> str:
    return "list_filter([" + ", ".join(f"case when {hits(text, p)} then {quoted(label)} end" for label, p in rules) + "], lambda x: x is not null)"


def lookup(values: dict, key: str, default: str) -> str:
    cell = lambda v: quoted(v) if isinstance(v, str) else repr(v)
    return f"case {key} " + " ".join(f"when {quoted(k)} then {cell(v)}" for k, v in values.items()) + f" else {default} end"


def distinct(a: str) -> str:
    """Values in the order of their first places."""
    return f"list_filter({a}, lambda x, i: list_position({a}, x) = i)"


def distinct_ci(a: str) -> str:
    return f"list_filter({a}, lambda x, i: list_position(list_transform({a}, lambda y: lower(y)), lower(x)) = i)"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def half_up(x: str, places: int = 0) -> str:
    k = 10.0**places
    return f"(floor(({x}) * {k}::double + 0.5::double) / {k}::double)"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def cut(x: str, limit: int) -> str:
    return f"case when length({trimmed(x)}) <= {limit} then {trimmed(x)} else regexp_replace(substr({trimmed(x)}, 1, {limit - 3}), '{SPACES}+$', '') || '...' end"


def decoded(x: str) -> str:
    out = cleaned(x)
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        out = f"replace({out}, '{entity}', '{char}')"
    return out


def slug(x: str) -> str:
    made = f"regexp_replace(regexp_replace(lower({cleaned(x)}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
    return f"coalesce(nullif(substr({made}, 1, 44), ''), 'item')"
