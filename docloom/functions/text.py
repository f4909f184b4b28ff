"""Text primitives as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of answer writing and of answer checking, suffix scales, refusal-exempt openers.
WRITING_STOP = "the a an of to in on for and or is are was were be by with as at from this that it its into per about over under it's you your our their has have had will".split()
CHECKING_STOP = "the a an of to in on for and or is are was were be been being by with as at from this that it its into per about over under you your our their has have had will may can could would should".split()
SCALES = {"million": 1e6, "m": 1e6, "billion": 1e9, "b": 1e9, "thousand": 1e3, "k": 1e3}
OPENERS = ("in summary", "overall", "note that", "this means", "in short")


def token_estimate(text: Column) -> Column:
    """At least 1; a token is four characters."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / 4).cast("long"))


def stable_id(*parts: Column) -> Column:
    """16 hex digits of the SHA-1 of the parts; a null part is the word None."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])), 1, 16)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """Unix line ends, single blanks, at most one empty line, stripped."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(lines, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def index_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def _keywords(found: Column, stop: list[str]) -> Column:
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(stop)))


def writing_keywords(text: Column) -> Column:
    return _keywords(index_tokens(text), WRITING_STOP)


def checking_keywords(text: Column) -> Column:
    return _keywords(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+(?:[-.][a-z0-9]+)*)"), F.lit(1)), CHECKING_STOP)


def sentences(text: Column) -> Column:
    """Split after . ! or ?; citation markers at a sentence's head go back to the one before."""
    raw = F.filter(F.split(strip(text), r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0)

    def attach(acc: Column, s: Column) -> Column:
        marks = F.regexp_extract(s, r"^(?:\[[0-9]+\]\s*)+", 0)
        rest = F.substring(s, F.length(marks) + 1, F.length(s))
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        joined = F.when((marks != "") & (F.size(acc) > 0), F.concat(head, F.array(F.concat(F.element_at(acc, -1), F.lit(" "), F.trim(marks))))).otherwise(acc)
        own = F.when((marks != "") & (F.size(acc) > 0), rest).otherwise(s)
        return F.when(own == "", joined).otherwise(F.concat(joined, F.array(own)))

    return F.aggregate(raw, F.array().cast("array<string>"), attach)


def numbers(text: Column) -> Column:
    """Numbers as doubles: as written and scaled by a suffix."""
    pattern = rf"(?i)(\d[\d,]*(?:\.\d*)?)\s*({'|'.join(SCALES)})?\b"
    raw = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    suffix = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), F.lower)
    value = F.transform(raw, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    scale = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])
    both = F.zip_with(value, suffix, lambda v, s: F.array(v, F.round(v * F.coalesce(F.element_at(scale, s), F.lit(1.0)))))
    return F.array_distinct(F.filter(F.flatten(both), lambda x: x.isNotNull()))


def markdown_strip(text: Column) -> Column:
    return F.regexp_replace(text, "[*_`#]+", "")


def needs_support(sentence: Column) -> Column:
    s = F.lower(strip(sentence))
    found = F.lit(False)
    for o in OPENERS:
        found = found | s.startswith(o)
    return (F.length(s) >= 15) & ~found


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; a zero length counts as 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(norm == 0, F.lit(1.0)).otherwise(norm)


def citations(text: Column) -> Column:
    """The numbers of a text's markers [n], in order, repeated ones included."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda m: m.cast("int"))


def breadcrumb(title: Column, path: Column) -> Column:
    """Title and path, each part once; blank parts of the path are left out."""
    parts = F.filter(path, lambda p: p.isNotNull() & (p != ""))
    return F.array_join(F.array_distinct(F.concat(F.array(title), parts)), " > ")


def chunk_text(label: Column, ordinal: Column, body: Column) -> Column:
    """A body under its label in brackets; a numbered item's label ends with its number."""
    item = F.concat(F.lit("item "), ordinal.cast("string"))
    whole = F.when(ordinal.isNull(), label).when(F.coalesce(label, F.lit("")) == "", item).otherwise(F.concat(label, F.lit(" \u00b7 "), item))
    return F.when(F.coalesce(whole, F.lit("")) == "", body).otherwise(F.concat(F.lit("["), whole, F.lit("]\n"), body))


def citation_label(source: Column, page: Column, path: Column) -> Column:
    """file (p.N), else the section path, else start."""
    trail = F.array_join(path, " > ")
    place = F.when(page.isNotNull(), F.concat(F.lit("p."), page.cast("string"))).when(F.coalesce(trail, F.lit("")) != "", trail).otherwise(F.lit("start"))
    return F.concat(source, F.lit(" ("), place, F.lit(")"))


def truncated(text: Column, tokens: int, mark: str) -> Column:
    """A text of more than so many tokens is cut there and marked."""
    return F.when(token_estimate(text) > tokens, F.concat(F.regexp_replace(F.substring(text, 1, tokens * 4), r"\s+$", ""), F.lit(mark))).otherwise(text)


def expanded(parent: Column, body: Column) -> Column:
    """The enclosing section where it is longer than the passage."""
    return F.when(F.length(F.coalesce(parent, F.lit(""))) > F.length(body), parent).otherwise(body)


def markdown_row(cells: list[Column]) -> Column:
    """One line of a Markdown table; nulls are empty, pipes escaped."""
    return F.concat(F.lit("| "), F.array_join(F.array(*[F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in cells]), " | "), F.lit(" |"))
