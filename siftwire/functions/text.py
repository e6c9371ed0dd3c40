"""Column functions over text: cleaning, addresses, tokens, similarity. Built-in expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: White space as feeds use it: Java's \s and the no-break, ideographic and other Unicode spaces.
WS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: A white-space character but the plain blank; a look-ahead that most characters fail at once; runs of white space that are no single blank.
ODD_WS = WS.replace(r"\s", r"\t\n\x0B\f\r")
MAYBE_WS = "(?=[^!-~])"
WS_RUN = rf"{MAYBE_WS}(?:{ODD_WS}{WS}*+|\x20{WS}++)"
WORD = "[0-9A-Za-z_]"
#: An ASCII word boundary; Java's own \b counts letters of every script.
BOUNDARY = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def alternatives(p: str) -> list[str]:
    """The parts of a pattern between the | that stand in no group and no class; none, if a group ends that did not begin."""
    out, depth, i, last = [], 0, 0, 0
    while i < len(p):
        if p[i] == "\\":
            i += 1
        elif p[i] == "[":
            while p[i] != "]":
                i += 2 if p[i] == "\\" else 1
        elif p[i] in "()":
            depth += 1 if p[i] == "(" else -1
            if depth < 0:
                return []
        elif p[i] == "|" and not depth:
            out.append(p[last:i])
            last = i + 1
        i += 1
    return [*out, p[last:]]


#: Characters outside ASCII that equal an ASCII letter in the other case.
FOLDED = {"i": "\u0130\u0131", "s": "\u017f", "k": "\u212a"}


def unwrapped(p: str) -> tuple[str, list[str], str]:
    """(opening, alternatives, closing) of a pattern: the groups around all of it and the parts inside."""
    parts, n = alternatives(p), 0
    while len(parts) == 1 and p[:1] == "(" and p[-1:] == ")" and p[1:2] != "?" and len(alternatives(p[1:-1])) > 1:
        p, n = p[1:-1], n + 1
        parts = alternatives(p)
    return "(" * n, parts, ")" * n


def head(part: str, most: int = 4) -> list[str]:
    """The first characters of every match of a part, at most `most`: those that are plain, and \\s, \\d and \\."""
    out: list[str] = []
    for m in re.finditer(r"(\\b|\\[sd.]|[^\\.()\[\]?*+{}|^$]|.)([?*+{]?)", part):
        c, many = m.groups()
        if c == "\\b" and not many:
            continue
        if c not in ("\\s", "\\d", "\\.") and (len(c) > 1 or c in "\\.()[]?*+{}|^$") or many in ("?", "*", "{"):
            break
        out.append(c)
        if many or len(out) == most:
            break
    return out


def any_of(cs: set[str]) -> str:
    """A class of these ASCII characters in either case; all outside ASCII too, if one of them there is among them or equals one."""
    plain = sorted({x for c in cs if len(c) == 1 and c < "\x80" for x in (c.lower(), c.upper())})
    far = any(len(c) == 1 and (c >= "\x80" or c.lower() in FOLDED) for c in cs)
    return "[" + "".join(sorted(c for c in cs if len(c) > 1)) + "".join(rf"\x{{{ord(c):x}}}" for c in plain) + (r"\x{80}-\x{10ffff}" if far else "") + "]"


def by_head(parts: list[str], heads: list[list[str]]) -> str:
    """The alternatives put together by their first character, which is looked at once for all of them. Those that can match at one place keep their
    order, so every match stays the same."""
    if len(parts) < 4 or any(len(h[0]) > 1 or h[0] >= "\x80" and (h[0].lower() != h[0] or h[0].upper() != h[0]) for h in heads):
        return "|".join(parts)
    groups: dict[str, list[tuple[str, list[str]]]] = {}
    for part, h in zip(parts, heads, strict=True):
        groups.setdefault(h[0].lower(), []).append((part, h))

    def look(c: str, hs: list[list[str]]) -> str:
        first = rf"\x{{{ord(c):x}}}" if c >= "\x80" else any_of({c})
        return f"(?-iu:(?={first}{''.join(any_of({h[i] for h in hs}) for i in range(1, min(len(h) for h in hs)))}))"

    def tree(cs: list[str]) -> str:
        if len(cs) < 4:
            return "|".join(f"{look(c, [h for _, h in groups[c]])}(?:{'|'.join(p for p, _ in groups[c])})" for c in cs)
        halves = cs[: len(cs) // 2], cs[len(cs) // 2 :]
        return "|".join(f"(?-iu:(?={any_of(set(half))}))(?:{tree(half)})" for half in halves)

    near = sorted(c for c in groups if c < "\x80")
    far = [c for c in groups if c >= "\x80"]
    return "|".join([tree(near)] * bool(near) + [f"{look(c, [h for _, h in groups[c]])}(?:{'|'.join(p for p, _ in groups[c])})" for c in far])


def heads_of(p: str) -> list[list[str]]:
    """The heads of the alternatives; none, if it is not plain which they are."""
    heads = [head(part) for part in unwrapped(p)[1]]
    return [] if not all(heads) or {c for h in heads for c in h} & set("".join(FOLDED.values())) else heads


def ahead(p: str) -> str:
    """A look-ahead at the first two characters with which a match of `p` can begin, or the first, or an empty string if it is not plain which these
    are. Most places of a text fail at it, without a try of each alternative. It lets through some places more, none less."""
    heads = heads_of(p)
    if not heads:
        return ""
    return "(?=" + "".join(any_of({h[i] for h in heads}) for i in range(min(2, *(len(h) for h in heads)))) + ")"


def parted(p: str, flags: str) -> str:
    """The alternatives that begin with ASCII, behind a look-ahead at up to four characters, and the others; those that begin with a letter that equals one
    outside ASCII are among both. At one place only one of these can match."""
    opening, parts, closing = unwrapped(p)
    pairs = list(zip(parts, heads_of(p), strict=True))
    near = [x for x in pairs if len(x[1][0]) > 1 or x[1][0] < "\x80"]
    far = [x for x in pairs if len(x[1][0]) == 1 and (x[1][0] >= "\x80" or x[1][0].lower() in FOLDED)]
    out = []
    if near:
        hs = [h for _, h in near]
        first = any_of({h[0] for h in hs}).replace(r"\x{80}-\x{10ffff}", "")
        look = first + "".join(any_of({h[i] for h in hs}) for i in range(1, min(len(h) for h in hs)))
        out.append(f"(?={look})(?{flags}:{by_head(*map(list, zip(*near, strict=True)))})")
    # Letters of other alphabets are frequent in many languages, and few patterns begin with them.
    for some, chars in (([x for x in far if x[1][0][0] < "\u2e80"], r"[^\x00-\x7f]"), ([x for x in far if x[1][0][0] >= "\u2e80"], r"[\x{2e80}-\x{10ffff}]")):
        if some:
            out.append(f"(?={chars})(?{flags}:{by_head(*map(list, zip(*some, strict=True)))})")
    return opening + "|".join(out) + closing


def pattern(p: str, ignore_case: bool = True) -> str:
    """A rule's pattern as Java's engine must get it: \\b is an ASCII word boundary. Next to a letter one side of it is known: the letter is
    matched first and the other side is looked at then, which costs nothing at the many places where the letter does not stand. See ahead."""
    look, flags = ahead(p), "iu" if ignore_case else ""
    p = f"(?:{parted(p, flags)})" if look else f"(?{flags}:{p})"
    p = re.sub(r"\\b([A-Za-z])(?![?*+{])", rf"\1(?<!{WORD}\1)", p)
    p = re.sub(r"\\b(?=\\d)", f"(?<!{WORD})", p)
    p = re.sub(r"((?<!\\)[A-Za-z0-9])\\b", rf"\1(?!{WORD})", p)
    return look + p.replace(r"\b", BOUNDARY)


def sieve(rules: list[str]) -> str:
    """A pattern of the stretches of a text in which any of the rules' patterns can match: what one match needs before and after it, and all matches that
    begin within that. Empty if a rule's matches have no bound, or it is not plain what they begin with."""
    parts = list(dict.fromkeys(part for p in rules for part in unwrapped(p)[1]))
    if not all(heads_of(p) for p in rules) or any(re.search(r"\\[^bd.]|(?<!\\)[.*+{]|\[\^|\(\?", part) for part in parts):
        return ""
    any_hit, most = pattern("|".join(parts)), max(len(p) for p in parts)  # a part has no more characters than its source
    return rf"(?s)(?:^|.)(?={any_hit})(?:(?={any_hit}).(?:(?!{any_hit}).){{0,{most}}}+)++"


def sieved(text: Column, rules: list[str]) -> Column:
    """The stretches of the text in which the rules can match, one look for all of them: each rule finds, counts and extracts in these what it
    would in the text. A control character stands between them, which no rule takes."""
    p = sieve(rules)
    return F.array_join(F.regexp_extract_all(text, F.lit(p), 0), "\x01") if p else text


def hits(text: Column, p: str, ignore_case: bool = True) -> Column:
    return text.rlike(pattern(p, ignore_case))


def count_hits(text: Column, p: str, ignore_case: bool = True) -> Column:
    return F.regexp_count(text, F.lit(pattern(p, ignore_case)))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{MAYBE_WS}{WS}++$", "")


def let(value: Column, use) -> Column:
    """`use` of a value that is built once, however often it is named: an expression that stands in functions over arrays, or in branches, is
    built again in each place otherwise."""
    return F.transform(F.array(value), use)[0]


def clean_text(c: Column) -> Column:
    """Tags become spaces, white space collapses; null becomes empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(text_or_empty(c), "<[^>]++>", " "), WS_RUN, " "))


def decode_html(c: Column) -> Column:
    """Cleaned text with five entities decoded, & first (so doubly encoded entities decode once more)."""
    out = clean_text(c)
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(c.cast("string").rlike("[^" + WS[1:]), c) for c in cols])


def truncate_text(c: Column, limit: int = 500) -> Column:
    """Trimmed text of at most `limit` characters, the last three being dots where it was cut."""
    t = trim_ws(text_or_empty(c))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, max(0, limit - 3)), f"{WS}+$", ""), F.lit("...")))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(clean_text(c)), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, 44), F.lit("")), F.lit("item"))


def canonical_url(c: Column) -> Column:
    """An http(s) address without tracking parameters, fragment, default port and one final slash; empty if it is none."""
    t = trim_ws(text_or_empty(c))
    parts = lambda i: F.regexp_extract(t, r"^(?i)(https?)://([^/?#\s]+)([^?#]*)(\?[^#]*)?(#.*)?$", i)
    scheme, host = F.lower(parts(1)), F.lower(parts(2))
    port = F.when(scheme == "http", ":80$").otherwise(":443$")
    host = F.regexp_replace(host, port, F.lit(""))
    path = F.when(parts(3) == "", F.lit("/")).otherwise(parts(3))
    names = F.array(*[F.lit(x) for x in fixed.TRACKING_PARAMS])
    kept = F.filter(F.split(F.substring(parts(4), 2, 1 << 30), "&"), lambda x: (x != "") & ~F.array_contains(names, F.substring_index(x, "=", 1)))
    query = F.array_join(kept, "&")
    url = F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(host != "", F.regexp_replace(url, "/$", "")).otherwise(F.lit(""))


def https_image(c: Column) -> Column:
    t = trim_ws(text_or_empty(c))
    return F.when(t.rlike(r"^(?i)https://[^/?#\s]+"), t).otherwise(F.lit(""))


def title_tokens(c: Column) -> Column:
    """Distinct lower-case runs of Latin letters, digits and Chinese characters, longer than one."""
    return F.array_distinct(F.filter(F.split(F.lower(clean_text(c)), r"[^a-z0-9\x{4e00}-\x{9fa5}]+"), lambda w: F.length(w) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def distinct_ignoring_case(a: Column, limit: int | None = None, make=lambda x: x) -> Column:
    """What `make` makes of the values, in order, without blanks if there is a limit, each but once, letters of either case being equal; the first
    `limit`, and no value is made after these. A fold reads the array once; a lambda that names it again would build it again for every value."""
    none = F.array().cast("array<string>")
    known = lambda kept, v: F.exists(kept, lambda y: F.lower(y) == F.lower(v))
    if limit is None:
        return F.aggregate(a, none, lambda kept, x: let(make(x), lambda v: F.when(known(kept, v), kept).otherwise(F.concat(kept, F.array(v)))))
    grown = lambda kept, x: let(make(x), lambda v: F.when((v == "") | known(kept, v), kept).otherwise(F.concat(kept, F.array(v))))
    return F.aggregate(a, none, lambda kept, x: F.when(F.size(kept) >= limit, kept).otherwise(grown(kept, x)))


def first_matches(text: Column, p: str, most: int, keep=None, start: int = 1000) -> Column:
    """All matches of `p` that `keep` takes, or at least the first `most` of them: they are looked for in the text's start, and in all of it only if
    that has too few. The two last matches of a start do not count, as its cut may part or shorten them."""
    found = lambda t: F.regexp_extract_all(t, F.lit(p), 0) if keep is None else F.filter(F.regexp_extract_all(t, F.lit(p), 0), keep)
    return let(text, lambda t: let(found(F.substring(t, 1, start)), lambda few: F.when((F.size(few) > most + 1) | (F.length(t) <= start), few).otherwise(found(t))))


def parse_date(c: Column) -> Column:
    """ISO dates and times (without a zone: UTC) and RFC 822 dates with or without a weekday; else null."""
    t = trim_ws(text_or_empty(c))
    bare = F.regexp_replace(t, r"^[A-Za-z]{3},\s*", "")
    rfc = [F.try_to_timestamp(bare, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm z", "d MMM yyyy HH:mm:ss")]
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"), t.try_cast("timestamp"))
    return F.coalesce(iso, *[F.when(bare.rlike(r"^\d{1,2} [A-Z][a-z]{2} \d{4}"), r) for r in rfc])


def date_in_text(c: Column) -> Column:
    """A day written 20YYMMDD, else 20YY-M-D with -, /, . or Chinese signs; null if there is none."""
    t = text_or_empty(c)
    compact = F.regexp_extract(t, r"(20\d{2}\d{2}\d{2})", 1)
    split = r"(20\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})"
    parts = F.concat_ws("-", F.regexp_extract(t, split, 1), F.lpad(F.regexp_extract(t, split, 2), 2, "0"), F.lpad(F.regexp_extract(t, split, 3), 2, "0"))
    return F.when(compact != "", F.try_to_timestamp(compact, F.lit("yyyyMMdd"))).when(t.rlike(split), F.try_to_timestamp(parts, F.lit("yyyy-MM-dd")))


def detect_language(explicit: Column, title: Column, summary: Column) -> Column:
    t = F.concat_ws(" ", text_or_empty(title), text_or_empty(summary))
    chinese, latin = t.rlike(r"[\x{4e00}-\x{9fff}]"), t.rlike("[A-Za-z]")
    given = F.lower(F.substring(clean_text(explicit), 1, 8))
    return F.when(given != "", given).when(latin & ~chinese, "en").when(chinese, "zh").otherwise("")


def detect_language_counts(text: Column) -> Column:
    """en from six Latin words with under six Chinese characters, zh from six of these, else unknown."""
    latin, chinese = F.regexp_count(text, F.lit(r"[A-Za-z]{2,}")), F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]"))
    return F.when((latin >= 6) & (chinese < 6), "en").when(chinese >= 6, "zh").otherwise("unknown")


def number(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "[,%]", "").try_cast("double")


def half_up(c: Column, places: int = 0) -> Column:
    """Rounding in which halves go up, negative ones too."""
    k = 10.0**places
    return F.floor(c * F.lit(k) + F.lit(0.5)) / F.lit(k)


def first_rule(text: Column, rules, otherwise) -> Column:
    """The label of the first (label, pattern) that the text holds."""
    out = F
    for label, p in rules:
        out = out.when(hits(text, p), F.lit(label))
    return out.otherwise(otherwise)


def all_rules(text: Column, rules) -> Column:
    """The labels of all (label, pattern) that the text holds, in order."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(hits(text, p), F.lit(label)) for label, p in rules])))


def lookup(values: dict, key: Column, default) -> Column:
    """A value by key from a small fixed table."""
    if not values:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def iso_week(ts: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))


def stable_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.lower(clean_text(c)).cast("binary")), 1, 12))


def column_or(df, name: str, default, kind: str) -> Column:
    """A column of `df`, or a default where it has none."""
    return F.col(name) if name in df.columns else F.lit(default).cast(kind)


def item_text(df) -> Column:
    tags = F.array_join(F.coalesce(column_or(df, "tags", None, "array<string>"), F.array().cast("array<string>")), " ")
    parts = [text_or_empty(column_or(df, c, None, "string")) for c in ("title", "summary", "content_excerpt")]
    return clean_text(F.concat_ws(" ", *parts, tags))
