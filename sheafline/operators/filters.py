"""The metadata filter language, compiled to one column for every retriever."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ORDERED = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


def compile_filter(spec: dict | None, column_of) -> Column:
    """A condition from ``spec``; column_of(key) gives the column of a label.

    ``{key: value}`` is equality; ``{key: {op: value}}`` takes $eq $ne $gt $gte $lt $lte
    $in $nin; $and and $or take lists. A missing (null) label never matches, even
    $ne and $nin; a value of another kind (text, number) than the label's is not equal
    to it and matches no ordering; truth values are 0 and 1; an empty spec matches all; an unknown operator is an error.
    """
    if not spec:
        return F.lit(True)
    parts = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            inner = [compile_filter(s, column_of) for s in value]
            joined = F.lit(key == "$and")
            for c in inner:
                joined = joined & c if key == "$and" else joined | c
            parts.append(joined)
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        else:
            parts += [_one(column_of(key), op, v) for op, v in (value.items() if isinstance(value, dict) else [("$eq", value)])]
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _text(column: Column) -> Column:
    """The value of a label of text (or of a date, in ISO form), else null."""
    return F.when(F.typeof(column).isin("string", "date", "timestamp", "timestamp_ntz"), column.cast("string"))


def _number(column: Column) -> Column:
    """The value of a number or truth value (0 or 1), else null; never an error."""
    written = column.cast("string")
    kind = F.typeof(column)
    return F.when(kind == "boolean", F.when(written == "true", 1.0).otherwise(0.0)).when(~kind.isin("string", "date", "timestamp", "timestamp_ntz"), written.try_cast("double"))


def _equals(column: Column, value) -> Column:
    """Equal in value and kind; a label of another kind is not equal, and not an error."""
    if isinstance(value, str):
        found = _text(column) == F.lit(value)
    elif isinstance(value, bool) or isinstance(value, float):
        found = _number(column) == F.lit(float(value))
    elif isinstance(value, int):
        whole = F.typeof(column).isin("tinyint", "smallint", "int", "bigint")  # compared digit by digit: exact beyond 2**53
        found = F.when(whole, column.cast("string") == F.lit(str(value))).otherwise(_number(column) == F.lit(float(value)))
    elif value is None:
        found = F.lit(False)
    else:
        raise ValueError(f"a value must be text, a number, a truth value or null: {value!r}")
    return F.coalesce(found, F.lit(False))


def _one(column: Column, op: str, value) -> Column:
    if op in ("$in", "$nin"):
        found = F.lit(False)
        for v in value:
            found = found | _equals(column, v)
        found = ~found if op == "$nin" else found
    elif op in ("$eq", "$ne"):
        found = _equals(column, value)
        found = ~found if op == "$ne" else found
    elif op in _ORDERED:
        if isinstance(value, str):
            found = getattr(_text(column), _ORDERED[op])(F.lit(value))
        elif isinstance(value, (int, float)):
            found = getattr(_number(column), _ORDERED[op])(F.lit(float(value)))
        else:
            found = F.lit(False)
    else:
        raise ValueError(f"unknown operator {op}")
    return F.coalesce(column.isNotNull() & found, F.lit(False))


def time_overlap(span_from: Column, span_to: Column, start: int, end: int) -> Column:
    """Dated rows whose span meets start..end (yyyymmdd); undated rows (0) don't."""
    return (span_from > 0) & (span_from <= end) & (span_to >= start)


def layer_scope(layer: Column, level: Column, scope: str = "mixed", levels: tuple[int, ...] = ()) -> Column:
    """mixed: leaves and summaries (of the levels); leaves; summaries and drill-down: summaries of the levels."""
    summary = layer == "summary"
    at_level = level.isin(*levels) if levels else F.lit(True)
    if scope == "leaves":
        return ~summary
    if scope in ("summaries", "drill-down"):
        return summary & at_level
    if scope == "mixed":
        return ~summary | at_level
    raise ValueError(f"unknown scope {scope}")
