"""Image sizes as a vision-language model sees them: the public resize rule, visual tokens, sequence lengths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels a side counts in, least and most pixels of an image, and what a sequence may hold.
FACTOR, LEAST_PIXELS, MOST_PIXELS = 32, 65_536, 655_360
LEAST_TOKENS, MOST_TOKENS, MOST_SEQUENCE, MOST_COMPLETION = 64, 640, 1536, 192
#: Sides may not differ by more than this.
MOST_RATIO = 200


def resized(width: Column, height: Column, factor: int = FACTOR, least: int = LEAST_PIXELS, most: int = MOST_PIXELS) -> Column:
    """width and height as multiples of ``factor``, shrunk or grown until the pixels are within bounds; null where there is no such size.

    Each side goes to the nearest multiple (halves to the even one). Above
    ``most`` pixels both are scaled down and rounded down, below ``least`` both
    are scaled up and rounded up.
    """
    w, h, unit = width.cast("double"), height.cast("double"), F.lit(float(factor))

    def size(side: Callable[[Column], Column]) -> Column:
        return F.struct(*[(side(x) * factor).cast("int").alias(name) for name, x in (("width", w), ("height", h))])

    plain = size(lambda x: F.bround(x / unit))
    pixels = plain["width"].cast("long") * plain["height"]
    shrink, grow = F.sqrt(w * h / F.lit(float(most))), F.sqrt(F.lit(float(least)) / (w * h))
    down = size(lambda x: F.greatest(F.lit(1).cast("long"), F.floor(x / shrink / unit)))
    up = size(lambda x: F.ceil(x * grow / unit))
    fits = (w > 0) & (h > 0) & (F.greatest(w, h) / F.least(w, h) <= MOST_RATIO)
    return F.when(fits, F.when(pixels > most, down).when(pixels < least, up).otherwise(plain))


def visual_tokens(size: Column, factor: int = FACTOR) -> Column:
    """Tokens that an image of a :func:`resized` size takes."""
    return (size["width"] / factor).cast("int") * (size["height"] / factor).cast("int")


#: Makes, on an executor, the function from (query, answer) to the text tokens of the prompt and of prompt and answer, two image marks included.
CounterFactory = Callable[[], Callable[[str, str], tuple[int, int]]]


#: What passes by the counter of text tokens.
_SEEN = ("id", "reference_tokens", "target_tokens")


def _counter(factory: CounterFactory):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = factory()
        for batch in batches:
            made = [count(q, a) for q, a in zip(batch.column("query").to_pylist(), batch.column("answer").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, _SEEN), *[pa.array([m[i] for m in made], pa.int64()) for i in range(2)]], names=[*_SEEN, "prompt_text", "total_text"])

    return run


def preflight(rows: DataFrame, factory: CounterFactory) -> DataFrame:
    """id, prompt_tokens, completion_tokens, total_tokens and problem of rows of id (string), query, answer, reference and target (structs of width and height).

    Nothing is truncated: a sequence, a completion or an image beyond its bounds
    has a problem. No pixels are read.
    """
    sizes = {side: resized(F.col(f"{side}.width"), F.col(f"{side}.height")) for side in ("reference", "target")}
    seen = rows.select("id", *[visual_tokens(size).alias(f"{side}_tokens") for side, size in sizes.items()], "query", "answer")
    both = seen.mapInArrow(_counter(factory), "id string, reference_tokens int, target_tokens int, prompt_text long, total_text long")
    extra = F.col("reference_tokens") + F.col("target_tokens") - 2
    told = both.select("id", "reference_tokens", "target_tokens", (F.col("prompt_text") + extra).alias("prompt_tokens"), (F.col("total_text") - F.col("prompt_text")).alias("completion_tokens"), (F.col("total_text") + extra).alias("total_tokens"))
    bad = lambda c: F.col(c).isNull() | ~F.col(c).between(LEAST_TOKENS, MOST_TOKENS)
    problem = F.when(bad("reference_tokens") | bad("target_tokens"), "image").when(F.col("total_tokens") > MOST_SEQUENCE, "sequence").when(~F.col("completion_tokens").between(1, MOST_COMPLETION), "completion")
    return told.select("id", "prompt_tokens", "completion_tokens", "total_tokens", problem.alias("problem"))
