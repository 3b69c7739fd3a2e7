"""Detection sets in completions: strict parsing and exact scoring.

Spark's JSON functions are lenient where these sets are strict (single objects,
single quotes, trailing text, unknown keys), so that one Arrow UDF parses a
completion and matches it, once, and returns all that the metrics need.
"""

from __future__ import annotations

import json
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxloom.functions.matching import match_many

GRID = 1000


def parse(raw: str | None) -> tuple[list[list[int]], list[str | None]]:
    """Boxes and labels of a completion; ValueError says why it is invalid."""
    if raw is None:
        raise ValueError("no completion")
    try:
        found = json.loads(raw)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    except ValueError as e:  # bad JSON, or a number of too many digits
        raise ValueError(f"not JSON: {str(e)[:80]}") from None
    if not isinstance(found, list):
        raise ValueError("not an array")
    boxes, labels = [], []
    for i, item in enumerate(found):
        if not isinstance(item, dict) or "bbox_2d" not in item or set(item) - {"bbox_2d", "label"}:
            raise ValueError(f"item {i} has other keys than bbox_2d and label")
        box, label = item["bbox_2d"], item.get("label")
        if not isinstance(box, list) or len(box) != 4 or any(type(v) is not int for v in box):
            raise ValueError(f"item {i} is not four whole numbers")
        if label is not None and not isinstance(label, str):
            raise ValueError(f"item {i} has a label that is no text")
        x1, y1, x2, y2 = box
        if not (0 <= x1 < x2 <= GRID and 0 <= y1 < y2 <= GRID):
            raise ValueError(f"item {i} is no box on the grid")
        boxes.append(box)
        labels.append(label)
    return boxes, labels


def serialize(boxes: list[list[int]], labels: list[str | None] | None = None) -> str:
    """The canonical text of a detection set."""
    labels = labels or [None] * len(boxes)
    return canonical([{"bbox_2d": list(b)} | ({} if n is None else {"label": n}) for b, n in zip(boxes, labels, strict=True)])


def canonical(value: Any, ascii_only: bool = False) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False)


_BOXES = T.ArrayType(T.ArrayType(T.IntegerType()))


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


_PARSED = pa.struct([("valid", pa.bool_()), ("error", pa.string()), ("boxes", pa.list_(pa.list_(pa.int32()))), ("canonical", pa.bool_())])


@F.arrow_udf(_fields(valid=T.BooleanType(), error=T.StringType(), boxes=_BOXES, canonical=T.BooleanType()))
def parsed(raw: pa.Array) -> pa.Array:
    """valid, error, sorted boxes, and whether the text is its own canonical form."""
    out = []
    for text in raw.to_pylist():
        try:
            boxes, labels = parse(text)
            out.append({"valid": True, "error": None, "boxes": sorted(boxes), "canonical": serialize(boxes, labels) == text})
        except ValueError as e:
            out.append({"valid": False, "error": str(e), "boxes": [], "canonical": False})
    return pa.array(out, _PARSED)


_SCORED = pa.struct([("valid", pa.bool_()), ("error", pa.string()), ("boxes", pa.list_(pa.list_(pa.int32()))), ("tp", pa.list_(pa.int32())), ("matched", pa.float64())])


def _flat(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All boxes of an array of sets, one after the other, and where each set's begin (and the end)."""
    sizes = pc.fill_null(pc.list_value_length(sets), 0).to_numpy()
    numbers = sets.flatten().flatten().to_numpy(zero_copy_only=False).astype(float)
    return numbers.reshape(-1, 4), np.r_[0, np.cumsum(sizes)]


def _lists(values: np.ndarray) -> pa.Array:
    """An array of lists, one a row of ``values``."""
    rows, n = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * n, pa.int32()), pa.array(values.ravel(), pa.int32()))


@F.arrow_udf(_fields(valid=T.BooleanType(), error=T.StringType(), boxes=_BOXES, tp=T.ArrayType(T.IntegerType()), matched=T.DoubleType()))
def scored(raw: pa.Array, targets: pa.Array) -> pa.Array:
    """As :func:`parsed`, with matches at each threshold and the largest total IoU."""
    found, errors = [], []
    for text in raw.to_pylist():
        try:
            found.append(sorted(parse(text)[0]))
            errors.append(None)
        except ValueError as e:
            found.append([])
            errors.append(str(e))
    boxes, error = pa.array(found, _SCORED.field("boxes").type), pa.array(errors, pa.string())
    tp, total = match_many(*_flat(boxes), *_flat(targets))
    return pa.StructArray.from_arrays([error.is_null(), error, boxes, _lists(tp), pa.array(total)], fields=list(_SCORED))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def agreement(a: pa.Array, b: pa.Array) -> pa.Array:
    """Matches of one prediction against another at each threshold."""
    return _lists(match_many(*_flat(a), *_flat(b), totals=False)[0])
