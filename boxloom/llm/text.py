"""Column helpers shared by the text operators."""

from __future__ import annotations

import gc
import string
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text worked on at once; the arrays of a step take some fifty times as much.
SLICE = 1 << 20

#: Runs of these end a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: Runs of these end a word where only digits, letters and non-ASCII characters count.
MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column, breaks: str = SPACES) -> Column:
    """The words of a text after :func:`lower_ascii`; null and blank texts have none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), breaks), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, though ``use`` may name it many times or inside other lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bounded(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows of at most ``limit`` in total; a larger row is a range of its own."""
    sizes = list(sizes)
    lo = total = 0
    for at, size in enumerate(sizes):
        if at > lo and total + size > limit:
            yield lo, at
            lo, total = at, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def give_back() -> None:
    """Return what Arrow holds unused to the machine, which a worker shares with others."""
    pa.default_memory_pool().release_unused()


_held: dict[str, dict] = {}


def held(kind: str) -> dict:
    """This worker's store of one kind, such as tokenizers. Workers go from stage to stage: a store of another kind is what a stage before needed, and is let go."""
    for other, store in _held.items():
        if other != kind and store:
            store.clear()
            gc.collect()
    return _held.setdefault(kind, {})


def slices(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that the texts in ``column`` have at most ``SLICE`` bytes, or are one text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for lo, hi in bounded(sizes, SLICE):
            yield batch.slice(lo, hi - lo)
        del batch
        give_back()
