"""JSON replies of a model: found in its text, unwrapped, checked against fields, asked for once more, else a default."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys under which an object may be wrapped.
WRAPPERS = ("properties", "parameters", "value", "result", "output")
EXAMPLES: dict[type, Any] = {str: "", int: 0, float: 0.0, bool: False, list: []}


def outer_object(text: Column) -> Column:
    """The text from its first { to its last }, fences aside; else the text."""
    bare = F.trim(text)
    fenced = F.trim(F.regexp_replace(F.get(F.split(bare, "```"), F.lit(1)), "^json", ""))
    inner = F.when(bare.startswith("```"), F.coalesce(fenced, bare)).otherwise(bare)
    found = F.regexp_extract(inner, r"(?s)\{.*\}", 0)
    return F.when(found == "", inner).otherwise(found)


def field(text: Column, name: str) -> Column:
    """A top-level field of a reply's object, or of an object that wraps it; null where there is none."""
    blob = outer_object(text)
    return F.coalesce(*[F.get_json_object(blob, f"$.{w}{name}") for w in ("", *(w + "." for w in WRAPPERS))])


def example(fields: dict[str, type]) -> dict[str, Any]:
    """An object of the wanted shape, for the prompt."""
    return {k: EXAMPLES.get(t) for k, t in fields.items()}


def parse(reply: str, fields: dict[str, type]) -> dict[str, Any] | None:
    """The reply's object with values of the wanted types, or None. A missing list is empty; so is a blank one."""
    text = reply.strip()
    if text.startswith("```"):
        text = text.split("```")[1].removeprefix("json")
    first, last = text.find("{"), text.rfind("}")
    try:
        found = json.loads(text[first : last + 1] if 0 <= first < last else text)
    except ValueError:
        return None
    if not isinstance(found, dict):
        return None
    for candidate in (found, *(found[w] for w in WRAPPERS if isinstance(found.get(w), dict))):
        values = {k: _value(candidate.get(k), t) for k, t in fields.items()}
        if None not in values.values():
            return values
    return None


def _value(x: Any, kind: type) -> Any:
    if kind is list:
        blank = x is None or (isinstance(x, str) and x.strip().lower() in ("", "none", "null"))
        return [] if blank else x if isinstance(x, list) else None
    if kind is float and isinstance(x, int) and not isinstance(x, bool):
        return float(x)
    return x if isinstance(x, kind) and isinstance(x, bool) == (kind is bool) else None


def ask(model: Callable[[str], str], prompt: str, fields: dict[str, type], default: dict[str, Any] | None = None) -> dict[str, Any]:
    """The model's object: asked once, then once more with the reply that did not fit, then the default."""
    shape = f"Answer with one JSON object like {json.dumps(example(fields))}."
    reply = model(f"{shape}\n{prompt}")
    found = parse(reply, fields)
    if found is None:
        found = parse(model(f"{shape}\n{prompt}\nThis did not fit, give the object only:\n{reply}"), fields)
    if found is None and default is None:
        raise ValueError(f"no object with {', '.join(fields)} in the reply: {reply[:200]}")
    return default if found is None else found
