"""Sizes of images from their first bytes, as columns over binary content; pixels are never decoded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxloom.functions.schema import SIZE

#: Bytes of a file in which a size is looked for, and segments of a JPEG file that are passed on the way.
HEAD, SEGMENTS = 1 << 20, 128
#: The longest side that counts as one.
MOST = (1 << 31) - 1
#: How files of each kind begin, and how those end that have an end mark (hexadecimal).
PNG, PNG_END = "89504E470D0A1A0A", "0000000049454E44AE426082"
JPEG, GIF, BMP, RIFF, WEBP = "FFD8FF", "47494638", "424D", "52494646", "57454250"
TIFF_LITTLE, TIFF_BIG = "49492A00", "4D4D002A"
#: JPEG segments that hold the size.
FRAMES = [f"FF{b:02X}" for b in range(0xC0, 0xD0) if b not in (0xC4, 0xC8, 0xCC)]


def _hex(data: Column, at: int | Column, n: int) -> Column:
    """``n`` bytes from place ``at`` (the first is 0) in hexadecimal."""
    return F.hex(F.substring(data, (F.lit(at) if isinstance(at, int) else at) + 1, F.lit(n)))


def _big(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def _little(data: Column, at: int, n: int) -> Column:
    return _big(F.concat(*[_hex(data, at + i, 1) for i in reversed(range(n))]))


def _size(width: Column, height: Column) -> Column:
    return F.when(width.between(1, MOST) & height.between(1, MOST), F.struct(width.cast("int").alias("width"), height.cast("int").alias("height")))


def _jpeg(data: Column) -> Column:
    """The size in the first frame segment; segments say how long they are."""
    begin = F.struct(F.lit(2).alias("at"), F.lit(None).cast(SIZE).alias("size"))

    def step(s: Column, _: Column) -> Column:
        mark, length = _hex(data, s["at"], 2), _big(_hex(data, s["at"] + 2, 2))
        found = F.when(mark.isin(FRAMES), _size(_big(_hex(data, s["at"] + 7, 2)), _big(_hex(data, s["at"] + 5, 2))))
        ahead = F.when(mark == "FFFF", s["at"] + 1).when(mark.startswith("FF") & (length >= 2), s["at"] + 2 + length.cast("int"))
        open_ = s["at"].isNotNull() & s["size"].isNull()
        return F.struct(F.when(open_, ahead).alias("at"), F.when(open_, found).otherwise(s["size"]).alias("size"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), begin, step)["size"]


def _webp(data: Column) -> Column:
    kind = _hex(data, 12, 4)
    lossy = _size(_little(data, 26, 2) % 16384, _little(data, 28, 2) % 16384)
    bits = _little(data, 21, 4)
    lossless = _size(bits % 16384 + 1, F.shiftright(bits, 14) % 16384 + 1)
    extended = _size(_little(data, 24, 3) + 1, _little(data, 27, 3) + 1)
    return F.when(kind == "56503820", lossy).when(kind == "5650384C", lossless).when(kind == "56503858", extended)


def _tiff(data: Column, big: bool) -> Column:
    """The tags 256 and 257 of the first directory; their values are short (kind 3) or long."""

    def number(at: Column, n: int) -> Column:
        return _big(_hex(data, at, n) if big else F.concat(*[_hex(data, at + i, 1) for i in reversed(range(n))]))

    def value(entry: Column) -> Column:
        return F.when(number(entry + 2, 2) == 3, number(entry + 8, 2)).otherwise(number(entry + 8, 4))

    first = F.when(number(F.lit(4), 4) < HEAD, number(F.lit(4), 4)).cast("int")
    entries = F.transform(F.sequence(F.lit(0), F.least(number(first, 2), F.lit(1000)).cast("int") - 1), lambda i: first + 2 + i * 12)
    of = lambda tag: F.get(F.transform(F.filter(entries, lambda e: number(e, 2) == tag), value), F.lit(0))
    return F.when(number(first, 2) > 0, _size(of(256), of(257)))


def size(head: Column) -> Column:
    """struct(width, height) of PNG, JPEG, GIF, BMP, TIFF and WebP images from their first ``HEAD`` bytes; null for anything else."""
    height = _little(head, 22, 4)
    kinds = [
        (_hex(head, 0, 8) == PNG, F.when(F.crc32(F.substring(head, 13, 17)) == _big(_hex(head, 29, 4)), _size(_big(_hex(head, 16, 4)), _big(_hex(head, 20, 4))))),
        (_hex(head, 0, 3) == JPEG, _jpeg(head)),
        (_hex(head, 0, 4) == GIF, _size(_little(head, 6, 2), _little(head, 8, 2))),
        (_hex(head, 0, 2) == BMP, _size(_little(head, 18, 4), F.when(height >= 1 << 31, (1 << 32) - height).otherwise(height))),
        (_hex(head, 0, 4) == TIFF_LITTLE, _tiff(head, False)),
        (_hex(head, 0, 4) == TIFF_BIG, _tiff(head, True)),
        ((_hex(head, 0, 4) == RIFF) & (_hex(head, 8, 4) == WEBP), _webp(head)),
    ]
    return reduce(lambda rest, k: F.when(k[0], k[1]).otherwise(rest), reversed(kinds), F.lit(None).cast(SIZE))


def whole(head: Column, tail: Column) -> Column:
    """Whether a file ends as its kind does: a PNG's last chunk, a JPEG's end mark (zeros may follow); other kinds have no mark."""
    end = F.hex(tail)
    cut = F.regexp_replace(end, "(?:00)+$", "")
    return F.when(_hex(head, 0, 8) == PNG, end.endswith(PNG_END)).when(_hex(head, 0, 3) == JPEG, cut.endswith("FFD9")).otherwise(F.lit(True))
