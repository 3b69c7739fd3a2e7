"""JSON lines read strictly: exact keys, exact kinds, nothing coerced.

Spark's reader takes ``{"id": 5}`` for a text, single quotes for JSON and text
after an object for nothing; where a line says what a job does, that will not
do. Each UDF gives the fields of a line, or what is wrong with it.
"""

from __future__ import annotations

import json
import math
from typing import Any

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

TASK_KEYS = ("reference_image", "reference_boxes", "target_image", "query")


def mapping(line: str) -> dict[str, Any]:
    try:
        found = json.loads(line)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    except ValueError as e:
        raise ValueError(f"not JSON: {str(e)[:80]}") from None
    if not isinstance(found, dict):
        raise ValueError("not an object")
    return found


def prediction_of(line: str) -> tuple[str, str]:
    row = mapping(line)
    if set(row) != {"id", "raw_completion"}:
        raise ValueError("other keys than id and raw_completion")
    if not isinstance(row["id"], str) or not row["id"]:
        raise ValueError("id is no text, or empty")
    if not isinstance(row["raw_completion"], str):
        raise ValueError("raw_completion is no text")
    return row["id"], row["raw_completion"]


def box_of(values: Any) -> list[float]:
    """Four finite numbers with some width and height."""
    if not isinstance(values, list) or len(values) != 4 or any(type(v) not in (int, float) for v in values):
        raise ValueError("a box is not four numbers")
    try:
        x1, y1, x2, y2 = map(float, values)
    except OverflowError:
        raise ValueError("a box is not finite") from None
    if not all(map(math.isfinite, (x1, y1, x2, y2))):
        raise ValueError("a box is not finite")
    if x2 <= x1 or y2 <= y1:
        raise ValueError("a box has no inside")
    return [x1, y1, x2, y2]


def boxes_of(value: Any) -> list[list[float]]:
    if not isinstance(value, list) or not value:
        raise ValueError("no reference boxes")
    return [box_of(v) for v in value]


def task_of(line: str) -> dict[str, Any]:
    """The fields of a manifest line. What keeps a task from running, but not the manifest from being read, is its ``problem``."""
    row = mapping(line)
    missing, unknown = sorted(set(TASK_KEYS) - set(row)), sorted(set(row) - {"id", *TASK_KEYS})
    if missing or unknown:
        raise ValueError(f"missing keys {missing}, unknown keys {unknown}")
    id_ = row.get("id")
    if "id" in row and (type(id_) not in (str, int) or not str(id_).strip()):
        raise ValueError("id is neither text nor whole number, or empty")
    out = {"id": None if "id" not in row else str(id_), "reference_image": None, "reference_boxes": None, "target_image": None, "query": None, "problem": None}
    try:
        out["reference_boxes"] = boxes_of(row["reference_boxes"])
        for key in ("query", "reference_image", "target_image"):
            if not isinstance(row[key], str) or not row[key].strip():
                raise ValueError(f"{key} is no text, or empty")
            out[key] = row[key].strip() if key == "query" else row[key]
    except ValueError as e:
        out["problem"] = str(e)
    return out


def _read(lines: pa.Array, kind: pa.StructType, of) -> pa.Array:
    out = []
    for line in lines.to_pylist():
        try:
            out.append(None if line is None or not line.strip() else dict(of(line)) | {"error": None})
        except ValueError as e:
            out.append({f.name: None for f in kind} | {"error": str(e)})
    return pa.array(out, kind)


_PREDICTION = pa.struct([("id", pa.string()), ("raw_completion", pa.string()), ("error", pa.string())])
_BOXES = T.ArrayType(T.ArrayType(T.DoubleType()))
_TASK = pa.struct([("id", pa.string()), ("reference_image", pa.string()), ("reference_boxes", pa.list_(pa.list_(pa.float64()))), ("target_image", pa.string()), ("query", pa.string()), ("problem", pa.string()), ("error", pa.string())])


@F.arrow_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("id", "raw_completion", "error")]))
def prediction(lines: pa.Array) -> pa.Array:
    """id and raw_completion, or error; null for blank lines."""
    return _read(lines, _PREDICTION, lambda line: zip(("id", "raw_completion"), prediction_of(line), strict=True))


@F.arrow_udf(T.StructType([T.StructField(f.name, _BOXES if f.name == "reference_boxes" else T.StringType()) for f in _TASK]))
def task(lines: pa.Array) -> pa.Array:
    """The fields of :func:`task_of`, or error; null for blank lines and those that begin with #."""
    kept = pa.array([None if x is None or x.lstrip().startswith("#") else x for x in lines.to_pylist()], pa.string())
    return _read(kept, _TASK, task_of)
