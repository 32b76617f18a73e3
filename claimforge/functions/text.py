"""Text normalisation and tests as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Punctuation that evidence comparison ignores, and the marks that a quoted source may lose.
EVIDENCE_MARKS = "，。；：、,.!?！？'\"“”‘’（）()"
MARKDOWN_MARKS = "*`|#-•"
QUESTION_ENDS = ("?", "？", "吗", "呢")
QUESTION_STARTS = ("如何", "怎么", "为什么", "是否", "能否", "可以", "可不可以")
QUESTION_PARTS = ("几年", "多少", "多久", "多长")


def quoted(chars: str) -> str:
    """The characters as the inside of a regular expression's class."""
    return "".join("\\" + c if c in "[]\\^-&" else c for c in chars)


#: Characters whose folding isn't their lower case, by Unicode's rules as Python knows them.
FOLDED = {c: c.casefold() for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]) if c.casefold() != c.lower()}
ONE = {c.lower(): f for c, f in FOLDED.items() if len(f) == 1}
MANY = {c: f for c, f in FOLDED.items() if len(f) > 1}


def _near(chars: Iterable[str], gap: int = 0x80) -> str:
    """A class of a few ranges that holds the characters, and others between them: a quick first test."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if ranges and c - ranges[-1][1] < gap and ranges[-1][0] > 0xFF:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


#: ß is common, and so it goes by itself.
LONGER, OTHER = _near(set(MANY) - {"ß"}), _near(ONE)


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def casefold(x: Column) -> Column:
    """Full case folding: lower case, but for the characters that fold to others (final sigma, ligatures, ß)."""
    longer = F.create_map(*[F.lit(t) for pair in MANY.items() for t in pair])
    spread = lambda v: F.array_join(F.transform(F.regexp_extract_all(v, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(longer, c), c)), "")
    lower = let(F.replace(x, F.lit("ß"), F.lit("ss")), lambda v: F.lower(F.when(v.rlike(LONGER), spread(v)).otherwise(v)))
    return let(lower, lambda v: F.when(v.rlike(OTHER), F.translate(v, "".join(ONE), "".join(ONE.values()))).otherwise(v))


def collapse_space(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def strip_space(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def drop_space(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+", "")


def entity_name(x: Column) -> Column:
    """The form under which entity names are equal."""
    return casefold(collapse_space(x))


def same_text_key(x: Column) -> Column:
    """The form under which texts are equal whatever their spacing and case."""
    return casefold(drop_space(x))


def evidence_text(x: Column) -> Column:
    """Text for containment tests: folded, without white space and punctuation."""
    return F.regexp_replace(casefold(x), rf"(?U)[\s{quoted(EVIDENCE_MARKS)}]+", "")


def contains_any(x: Column, markers: Iterable[str]) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(x, F.lit(m))
    return F.coalesce(found, F.lit(False))


def starts_with_any(x: Column, prefixes: Iterable[str]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | F.startswith(x, F.lit(p))
    return F.coalesce(found, F.lit(False))


def ends_with_any(x: Column, suffixes: Iterable[str]) -> Column:
    found = F.lit(False)
    for s in suffixes:
        found = found | F.endswith(x, F.lit(s))
    return F.coalesce(found, F.lit(False))


def question_like(x: Column) -> Column:
    """Whether a text asks for information."""
    t = strip_space(x)
    return ends_with_any(t, QUESTION_ENDS) | starts_with_any(t, QUESTION_STARTS) | contains_any(t, QUESTION_PARTS)


def lines(x: Column) -> Column:
    """Non-blank lines, trimmed."""
    return F.filter(F.transform(F.split(x, r"\R"), strip_space), lambda t: F.length(t) > 0)


def fragments(x: Column) -> Column:
    """Pieces between clause marks, in evidence form, blanks dropped."""
    return F.filter(F.transform(F.split(x, r"[；;。：:\n，,（）()]"), evidence_text), lambda t: F.length(t) > 0)


def supported_by(value: Column, source: Column) -> Column:
    """Every fragment of the value occurs in the source, and there is one."""
    parts = fragments(value)
    return (F.size(parts) > 0) & F.forall(parts, lambda t: F.contains(evidence_text(source), t))


def preview(x: Column, n: int = 160) -> Column:
    return F.left(x, F.lit(n))


def truncated(x: Column, n: int = 240) -> Column:
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("…"))).otherwise(x)


def falsy_chain(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values[:-1]], values[-1])


def natural_key(x: Column) -> Column:
    """A sort key under which runs of digits compare as numbers: digits padded to 20 places."""
    parts = F.regexp_extract_all(x, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p)), "")


def first_heading(texts: Column, default: Column) -> Column:
    """The first Markdown heading in an array of texts, without its marks."""
    found = F.filter(F.flatten(F.transform(texts, lambda t: F.split(t, r"\R"))), lambda line: line.rlike(r"^\s*#+\s*[^#\s]"))
    return F.coalesce(F.get(F.transform(found, lambda line: F.regexp_replace(line, r"^\s*#+\s*|\s+$", "")), F.lit(0)), default)


def common_prefix(texts: Column) -> Column:
    """The longest prefix that all texts of an array share: that of the least and the greatest."""
    lo, hi = F.array_min(texts), F.array_max(texts)
    same = F.filter(F.sequence(F.lit(0), F.least(F.length(lo), F.length(hi))), lambda n: F.left(lo, n.cast("int")) == F.left(hi, n.cast("int")))
    return F.left(lo, F.array_max(same).cast("int"))


def duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).otherwise(F.concat(F.format_number(ms / 1000, 1), F.lit(" s")))
