"""The default planner: rules that turn a question into a plan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinal words, and cues of small talk and of tables.
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth".split()
NOUN = r"(?:question|item|problem|section|step|exercise)s?"
SMALL_TALK = re.compile(r"(?i)^\s*(?:hi|hello|hey|thanks|thank you|good (?:morning|evening))\b[^?]{0,40}$")
TABLES = re.compile(r"(?i)\b(?:total|sum|average|mean|how many|how much|highest|lowest|per (?:month|quarter|region)|by (?:month|quarter|region))\b")
LAST = -1
#: What a question about a whole document asks for.
BROAD = "|".join((
    r"\b(?:what|which) (?:topics|subjects|themes)\b", r"\b(?:list|name|show) (?:all|each|every)\b", r"\bevery (?:item|question|section)\b", r"\bsummar(?:i[sz]e|y)", r"\boverview\b",
    r"\bhow many [^.?!]{1,25} (?:are|is)\b", r"\bwhich (?:items|parts|questions|sections) (?:[^.?!]{1,25} )?(?:are|about)\b",
))


def is_broad(question: Column) -> Column:
    return F.lower(question).rlike(BROAD)


def remapped(ordinals: Column, subset: Column) -> Column:
    """Positions in the items shown before become their numbers; numbers that were shown, or are no position, stay."""

    def one(n: Column) -> Column:
        last = (n == LAST) & (F.size(subset) > 0)
        return F.when(last, F.element_at(subset, -1)).when((n >= 1) & (n <= F.size(subset)) & ~F.array_contains(subset, n), F.get(subset, n - 1)).otherwise(n)

    return F.transform(F.coalesce(ordinals, F.array().cast("array<int>")), one)



@dataclass
class Plan:
    intent: str = "document"
    sub_queries: list[str] = field(default_factory=list)
    ordinals: list[int] = field(default_factory=list)
    broad: bool = False
    needs_tables: bool = False


def ordinals(question: str) -> list[int]:
    """Item numbers that a question names; -1 is the last item."""
    found = [int(a or b) for a, b in re.findall(rf"(?i)\b{NOUN}\s+#?(\d{{1,3}})\b|\b(\d{{1,3}})(?:st|nd|rd|th)\s+{NOUN}", question)]
    found += [i + 1 for i, w in enumerate(ORDINALS) if re.search(rf"(?i)\b{w}\s+{NOUN}", question)]
    found += [LAST] if re.search(rf"(?i)\blast\s+{NOUN}", question) else []
    return list(dict.fromkeys(found))


def plan(question: str, subset: list[int] | None = None) -> Plan:
    """subset: ordinals shown before; a question's n-th item is then the n-th of them."""
    named = ordinals(question)
    if subset:
        named = [subset[-1] if n == LAST else subset[n - 1] if n <= len(subset) and n not in subset else n for n in named]
    # a question about an item is never small talk, and a plan has always a query
    intent = "chitchat" if SMALL_TALK.match(question) and not named else "table" if TABLES.search(question) else "document"
    parts = [p.strip() for p in re.split(r"(?<=\?)\s+", question) if p.strip()]
    return Plan(intent, parts or [question], named, bool(re.search(BROAD, question.lower())), intent == "table")


#: What a question's words make of a column.
MEASURES = (("avg", r"average|mean"), ("max", r"highest|largest|maximum|most"), ("min", r"lowest|smallest|minimum|least"), ("sum", r"total|sum|how much|overall"), ("count", r"how many|number of|count"))
NUMERIC = ("int", "bigint", "double", "float", "decimal", "smallint", "tinyint", "long")


def table_sql(question: str, tables: dict[str, list[tuple[str, str]]]) -> str:
    """A statement over the table whose columns a question names best; empty if it names none.

    tables: columns (name, type) by table. The measure comes from the question's words, the groups from what follows
    by, per or each; without a measure the rows are shown.
    """
    words = set(re.findall("[a-z0-9]+", question.lower()))
    stems = words | {w.rstrip("s") for w in words}
    named = lambda c: sum(p in stems or p.rstrip("s") in stems for p in c.lower().split("_"))
    scored = sorted(((sum(named(c) for c, _ in cols), named(t), t) for t, cols in tables.items()), key=lambda x: (-x[0], -x[1], x[2]))
    if not scored or not scored[0][0] + scored[0][1]:
        return ""
    table = scored[0][2]
    columns = tables[table]
    after = re.findall(r"\b(?:by|per|each|every)\s+([a-z0-9]+)", question.lower())
    groups = [c for c, _ in columns if any(p.rstrip("s") in [a.rstrip("s") for a in after] for p in c.lower().split("_"))]
    measure = next((m for m, cue in MEASURES if re.search(rf"\b(?:{cue})\b", question.lower())), None)
    numbers = sorted((c for c, t in columns if t.lower().startswith(NUMERIC) and c not in groups and named(c)), key=lambda c: -named(c))
    quoted = lambda c: f"`{c}`"
    if measure == "count" or (measure and not numbers):
        what = numbers and f"sum({quoted(numbers[0])}) AS {quoted('total_' + numbers[0])}" or "count(*) AS `n`"
    elif measure:
        what = f"{measure}({quoted(numbers[0])}) AS {quoted(measure + '_' + numbers[0])}"
    else:
        shown = [quoted(c) for c, _ in columns if named(c)] or ["*"]
        return f"SELECT {', '.join(shown)} FROM {quoted(table)}"
    keys = ", ".join(map(quoted, groups))
    return f"SELECT {keys}, {what} FROM {quoted(table)} GROUP BY {keys} ORDER BY {keys}" if groups else f"SELECT {what} FROM {quoted(table)}"
