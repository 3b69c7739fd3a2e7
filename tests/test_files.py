"""Image sizes from headers, files read once and in pieces, and outputs that lie together."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from boxloom.errors import DataError
from boxloom.functions import images
from boxloom.plans import predict
from boxloom.sources import files
from tests.test_plans import png


def jpeg(width, height, segments=2):
    skipped = b"".join(b"\xff" + bytes([0xE0 + i % 16]) + struct.pack(">H", 2 + 300) + b"\xff" * 300 for i in range(segments))
    frame = b"\xff\xc2" + struct.pack(">HBHHB", 8 + 9, 8, height, width, 3) + b"\x01\x11\x00" * 3
    return b"\xff\xd8" + skipped + b"\xff" + frame + b"\xff\xd9"  # a filling byte before the frame


def bmp(width, height):
    return b"BM" + bytes(12) + struct.pack("<IiiHH", 40, width, height, 1, 24) + bytes(20)


def tiff(width, height, order):
    tags = [(254, 4, 0), (256, 3, width), (257, 4, height), (258, 3, 8)]
    short = lambda v: struct.pack(order + "HH", v, 0)
    rows = b"".join(struct.pack(order + "HHI", t, k, 1) + (short(v) if k == 3 else struct.pack(order + "I", v)) for t, k, v in tags)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 20) + bytes(12) + struct.pack(order + "H", len(tags)) + rows + bytes(4)


def webp(kind, body):
    return b"RIFF" + struct.pack("<I", 22 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


CASES = {
    "png": (png(40, 28, 3), (40, 28)), "jpeg": (jpeg(640, 480), (640, 480)), "jpeg of many segments": (jpeg(33, 44, 90), (33, 44)), "bmp": (bmp(70, 50), (70, 50)), "bmp upside down": (bmp(70, -50), (70, 50)),
    "gif": (b"GIF89a" + struct.pack("<HH", 300, 200) + bytes(9), (300, 200)), "tiff": (tiff(123, 456, "<"), (123, 456)), "big tiff": (tiff(123, 70_000, ">"), (123, 70_000)),
    "webp lossy": (webp(b"VP8 ", bytes(3) + b"\x9d\x01\x2a" + struct.pack("<HH", 176 | 1 << 14, 144)), (176, 144)), "webp lossless": (webp(b"VP8L", b"\x2f" + struct.pack("<I", (319 << 0) | (239 << 14)) + bytes(8)), (320, 240)),
    "webp extended": (webp(b"VP8X", bytes(4) + (4999).to_bytes(3, "little") + (99).to_bytes(3, "little")), (5000, 100)),
    "empty": (b"", None), "text": (b"no image at all, but long enough to be one" * 3, None), "broken header": (png(40, 28, 3).replace(b"IHDR\0\0\0\x28", b"IHDR\0\0\0\x29"), None), "cut jpeg": (jpeg(640, 480)[:30], None),
    "no side": (bmp(0, 4), None), "tiff without an end": (tiff(1, 2, "<")[:24], None), "png header only": (png(40, 28, 3)[:20], None),
}


def test_sizes(spark):
    rows = spark.createDataFrame([(k, bytearray(v[0])) for k, v in CASES.items()], "name string, data binary")
    found = {r["name"]: r["s"] and tuple(r["s"]) for r in rows.select("name", images.size(F.col("data")).alias("s")).collect()}
    assert found == {k: v[1] for k, v in CASES.items()}


@pytest.mark.parametrize("whole", [files.WHOLE, 100])
def test_images_of_a_folder(spark, tmp_path, whole):
    made = {"a.png": png(40, 28, 1), "b.JPG": jpeg(64, 48), "c.tif": tiff(5, 6, "<"), "cut.png": png(40, 28, 2)[:-4], "cut2.jpg": jpeg(9, 9)[:-2], "no.png": b"x" * 500, "skip.txt": b"t"}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.images(spark, f"file://{tmp_path}", "s", whole).collect()}
    assert {n: (r["width"], r["height"]) for n, r in rows.items()} == {"a.png": (40, 28), "b.JPG": (64, 48), "c.tif": (5, 6), "cut.png": (None, None), "cut2.jpg": (None, None), "no.png": (None, None)}
    assert all(r["content_sha256"] == hashlib.sha256(made[n]).hexdigest() for n, r in rows.items())
    (tmp_path / "a.jpg").write_bytes(b"x")
    with pytest.raises(DataError, match="several images called"):
        files.images(spark, f"file://{tmp_path}", "s")


def test_a_file_of_more_than_two_gigabytes(spark, tmp_path):
    data = png(40, 28, 1)
    with open(tmp_path / "huge.png", "wb") as f:
        f.write(data[:-12])
        f.seek((1 << 31) + 5000)
        f.write(data[-12:])
    (row,) = files.images(spark, f"file://{tmp_path}", "s").collect()
    assert (row["width"], row["height"]) == (40, 28)
    digest = hashlib.sha256()
    with open(tmp_path / "huge.png", "rb") as f:
        while piece := f.read(1 << 24):
            digest.update(piece)
    assert row["content_sha256"] == digest.hexdigest()


def tasks(spark, n):
    return spark.range(n).selectExpr("id AS ordinal", "id + 1 AS line", "concat('t', id) AS id", "concat('t', id) AS output_name", "'r' AS reference_image", "'t' AS target_image", "'q' AS query")


def results(rows, said="[]"):
    return rows.selectExpr("id", "ordinal", "if(ordinal % 50 = 0, 'failed', 'ok') AS status", f"if(ordinal % 50 = 0, null, '{said}') AS raw_completion", "if(ordinal % 50 = 0, 'why', null) AS error")


def test_outputs_lie_together(spark, tmp_path):
    folder, rows = str(tmp_path / "outputs"), tasks(spark, 100_000)
    assert predict.finished(spark, folder).count() == 0
    predict.write_outputs(results(rows), rows, folder)
    parts = list((tmp_path / "outputs").glob("part-*"))
    assert 2 <= len(parts) <= 12 and predict.finished(spark, folder).count() == 98_000
    again = rows.where("ordinal < 10")
    predict.write_outputs(results(again, '[{"bbox_2d":[1,1,2,2]}]'), again, folder)
    found = {r["output_name"]: r["value"] for r in predict.outputs(spark, folder).where("output_name IN ('t3', 't33')").collect()}
    assert "bbox_2d" in found["t3"] and "bbox_2d" not in found["t33"]


def test_a_failed_write_leaves_no_outputs(spark, tmp_path):
    folder, rows = str(tmp_path / "outputs"), tasks(spark, 500)
    predict.write_outputs(results(rows), rows, folder)
    before = sorted(p.name for p in (tmp_path / "outputs").glob("part-*"))
    bad = results(rows).withColumn("raw_completion", F.when(F.col("ordinal") == 499, F.raise_error("the task dies").cast("string")).otherwise(F.col("raw_completion")))
    with pytest.raises(Exception, match="the task dies"):
        predict.write_outputs(bad, rows, folder)
    assert sorted(p.name for p in (tmp_path / "outputs").glob("part-*")) == before


def test_result_lines_in_order(spark, tmp_path):
    rows = tasks(spark, 120)
    predict.write_results(predict.result_lines(results(rows), rows, "out"), str(tmp_path / "lines"))
    lines = [x for p in sorted((tmp_path / "lines").glob("part-*")) for x in p.read_text().splitlines()]
    assert len(lines) == 120 and lines[0] == '{"error":"why","id":"t0","line":1,"status":"failed"}' and lines[7] == '{"detection_set":[],"id":"t7","result":"out#t7","status":"ok"}'
