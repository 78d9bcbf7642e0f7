"""JSON as Python's own reader and writer see it, over Arrow batches.

Spark's variant and its JSON writer change numbers (12.0 becomes 12, 1.5e-07 becomes 1.5E-7, long integers become doubles) and refuse repeated
keys. Stored details and ids that are derived from a line have to agree with what Python's json module gives, so these few
functions ask it; what follows from the parts is left to Column expressions.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StringType

#: Names of the kinds of values, by Python's types.
_KINDS = {type(None): "null", str: "string", bool: "boolean", int: "number", float: "number", list: "array", dict: "object"}


def loaded(text: str | None):
    """The value of a JSON text, and whether it is one: repeated keys have their last value, NaN and Infinity are numbers."""
    try:
        return json.loads(text), True
    except (TypeError, ValueError, RecursionError):
        return None, False


def written(value, compact: bool = False) -> str | None:
    """A value as JSON with keys in order at every depth; compact is without spaces and beyond ASCII escaped. Halves of surrogate pairs, which Spark's strings can't hold, are escaped."""
    try:
        if compact:
            return json.dumps(value, sort_keys=True, separators=(",", ":"))
        return json.dumps(value, ensure_ascii=False, sort_keys=True).encode("utf-8", "backslashreplace").decode()
    except (ValueError, RecursionError):
        return None


def _writer(compact: bool):
    def run(lines: pa.Array) -> pa.Array:
        out = []
        for line in lines.to_pylist():
            value, good = loaded(line)
            out.append(written(value, compact) if good else None)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, StringType())


_spaced, _compact = _writer(False), _writer(True)


def canonical(text: Column, compact: bool = False) -> Column:
    """A JSON text with its keys in order at every depth and its numbers in Python's shortest form; null for what is no JSON."""
    return (_compact if compact else _spaced)(text)


def _as_text(value) -> str | None:
    if value is None:
        return None
    return (value if isinstance(value, str) else str(value)).encode("utf-8", "replace").decode()


def _flags(value) -> dict:
    return {"void": value is None or value == "", "falsy": not value, "blank": not isinstance(value, str) or not value.strip()}


def reader(fields: tuple[str, ...]):
    """A function of lines that gives what is in each: `keys` (null for what is no object), the named fields as text with their `kinds`, those of them
    that are `falsy` (null, empty, zero or false), and `details`: its kind, its canonical text, and flags of each value in it."""

    def run(lines: pa.Array) -> pa.Array:
        out = []
        for line in lines.to_pylist():
            event, _ = loaded(line)
            if not isinstance(event, dict):
                out.append({})
                continue
            own = {x: event.get(x) for x in fields}
            details = event.get("details")
            row = {x: _as_text(v) for x, v in own.items()}
            row["keys"] = [_as_text(x) for x in event]
            row["kinds"] = {x: _KINDS[type(v)] for x, v in own.items()}
            row["falsy"] = [x for x, v in own.items() if not v]
            row["details_kind"], row["details"] = _KINDS[type(details)], written(details)
            row["inner"] = [(_as_text(k), _flags(v)) for k, v in details.items()] if isinstance(details, dict) else None
            out.append(row)
        return pa.array(out, kind)

    text = pa.string()
    names = [(x, text) for x in fields]
    value = pa.struct([(x, pa.bool_()) for x in ("void", "falsy", "blank")])
    kind = pa.struct([("keys", pa.list_(text)), *names, ("kinds", pa.struct(names)), ("falsy", pa.list_(text)), ("details_kind", text), ("details", text), ("inner", pa.map_(text, value))])
    return F.arrow_udf(run, from_arrow_type(kind))
