import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from boxloom.errors import ArtifactError, ConfigError, DataError, exit_code
from boxloom.plans import compile as compile_plan
from boxloom.plans import evaluate, gates, sinks
from boxloom.sources import config, files
from boxloom.streaming import incremental


def png(width, height, shade):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + bytes([shade % 256, shade // 256, 7]) * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


WIDTH, HEIGHT, CONCEPTS = 40, 28, ("ring", "vase", "lamp")


def annotation(items, width=WIDTH, height=HEIGHT):
    objects = "".join(f"<object><name>{n}</name><bndbox><xmin>{a}</xmin><ymin>{b}</ymin><xmax>{c}</xmax><ymax>{d}</ymax></bndbox></object>" for n, a, b, c, d in items)
    return f"<annotation><size><width>{width}</width><height>{height}</height><depth>3</depth></size>{objects}</annotation>"


@pytest.fixture
def scene(tmp_path):
    """A folder of images and notes, and the objects of each noted image; two images have no note and three no objects."""
    rng, noted = random.Random(13), {}
    images, notes = tmp_path / "images", tmp_path / "notes"
    images.mkdir(), notes.mkdir()
    for i in range(47):
        kinds = [] if i < 3 else [CONCEPTS[i % 3]] + rng.choices(CONCEPTS, k=rng.randrange(3))
        items = []
        for kind in kinds:
            x, y = rng.randrange(1, 20), rng.randrange(1, 14)
            items.append((kind, x, y, x + rng.randrange(3, 20), y + rng.randrange(3, 14)))
        name = f"scene{i * 7:04d}"
        (images / f"{name}.png").write_bytes(png(WIDTH, HEIGHT, i))
        if i < 45:
            (notes / f"{name}.xml").write_text(annotation(items))
            noted[f"{name}.png"] = items
    return tmp_path, noted


def compile_config(folder, out="dataset"):
    source = {"name": "s", "image_dir": f"file://{folder}/images", "annotation_dir": f"file://{folder}/notes"}
    return config.load(json.dumps({"kind": "compile", "sources": [source], "output": f"file://{folder}/{out}"}))


def test_compile_and_evaluate(spark, scene):
    folder, noted = scene
    made = compile_plan.compile_dataset(spark, compile_config(folder))
    parts = compile_plan.open_dataset(spark, made)
    rows = parts["train"].unionByName(parts["validation"]).unionByName(parts["test"]).cache()
    # a row an image and concept, and for each image one concept that it lacks, if there is one
    held = [(path, kind) for path, items in noted.items() for kind in {i[0] for i in items}]
    lacking = [path for path, items in noted.items() if {i[0] for i in items} != set(CONCEPTS)]
    told = rows.select("positive", F.col("target.path").alias("path"), "visual_concept", "target.boxes_xyxy").collect()
    assert sorted((r["path"], r["visual_concept"]) for r in told if r["positive"]) == sorted(held)
    assert sorted(r["path"] for r in told if not r["positive"]) == sorted(lacking)
    for r in told:  # places count from one, and both ends are inside
        assert [list(b) for b in r["boxes_xyxy"]] == sorted([x1 - 1, y1 - 1, x2, y2] for kind, x1, y1, x2, y2 in noted[r["path"]] if kind == r["visual_concept"])
    audit = sinks.read_document(spark, f"{made}/audit.json")
    assert audit["orphan_images"] == 2 and sum(r["images"] for r in audit["splits"]) == len(noted)
    with pytest.raises(ArtifactError):
        compile_plan.compile_dataset(spark, compile_config(folder))
    said = rows.select("id", F.to_json("detection_set").alias("raw_completion"))
    report = evaluate.evaluate(spark, rows, said, f"file://{folder}/report")
    overall = next(s for s in report["slices"] if s["slice"] == "overall")
    assert overall["f1"] == 1.0 and overall["strict_valid_rate"] == 1.0
    again = evaluate.evaluate(spark, rows.orderBy(F.rand(1)), said.repartition(3), f"file://{folder}/again")
    assert again == report
    assert evaluate.open_report(spark, f"file://{folder}/report")["prediction_hash"] == report["prediction_hash"]
    path = next((folder / "dataset" / "train").glob("part-*"))
    path.write_text(path.read_text() + "\n")
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ArtifactError):
        compile_plan.open_dataset(spark, made)


def test_broken_annotations_are_told_together(spark, scene):
    folder, noted = scene
    first, second = sorted(noted)[5:7]
    (folder / "notes" / first.replace("png", "xml")).write_text("<!DOCTYPE x>" + annotation([]))
    (folder / "notes" / second.replace("png", "xml")).write_text(annotation([("ring", 3, 3, WIDTH + 9, 8)]))
    (folder / "notes" / "nowhere.xml").write_text(annotation([]))
    with pytest.raises(DataError) as e:
        compile_plan.compile_dataset(spark, compile_config(folder, "other"))
    assert all(n in str(e.value) for n in (first[:-4], second[:-4], "nowhere"))


def test_scans(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id":"a","raw_completion":"[]"}\n\n{"raw_completion":"x","id":"b"}\n')
    assert files.predictions(spark, f"file://{tmp_path}/p.jsonl").count() == 2
    (tmp_path / "q.jsonl").write_text('{"id":"a","raw_completion":"[]","more":1}\n')
    with pytest.raises(Exception, match="not a prediction"):
        files.predictions(spark, f"file://{tmp_path}/q.jsonl").collect()
    task = '{"reference_image":"r.png","reference_boxes":[[1,2,3,4]],"target_image":"/t.png","query":"q"}'
    (tmp_path / "m.jsonl").write_text(f"# head\n{task}\n\n" + task.replace("{", '{"id":"x y",', 1) + "\n")
    rows = files.manifest(spark, f"file://{tmp_path}/m.jsonl").orderBy("ordinal").collect()
    assert [(r["id"], r["output_name"], r["target_image"]) for r in rows] == [("task-000000", "task-000000", "/t.png"), ("x y", "x_y", "/t.png")]
    assert rows[0]["reference_image"] == f"file://{tmp_path}/r.png"


def test_config():
    a = config.load('{"kind":"schedule","epochs":2,"seed":5}')
    assert config.config_hash(a) == config.config_hash(config.load('{"seed":5,"kind":"schedule","epochs":2.0,"world":1}'))
    for bad in ('{"kind":"schedule"}', '{"kind":"schedule","epochs":true}', '{"kind":"schedule","epochs":1,"x":1}', '{"kind":"schedule","epochs":1,"epochs":2}', '{"kind":"no"}', "[", '{"kind":"schedule","epochs":0}'):
        with pytest.raises(ConfigError):
            config.load(bad)
    assert exit_code(ConfigError()) == 2 and exit_code(ValueError()) == 1


def test_evidence(spark, tmp_path):
    rng = random.Random(3)
    told = {gate: rng.random() < 0.5 for gate in ("C2", "D1", "H1", "H2")}
    (tmp_path / "many.json").write_text(json.dumps({"gates": [{"gate": g, "status": "pass" if told[g] else "fail"} for g in ("H2", "D1", "C2")]}))
    (tmp_path / "one.json").write_text(json.dumps({"gate": "H1", "passed": told["H1"]}))
    rows = gates.read_evidence(spark, [f"file://{tmp_path}/many.json", f"file://{tmp_path}/one.json"])
    assert {r[0]: r[1] for r in rows.collect()} == told
    (tmp_path / "cut.json").write_text('{"gate": "C0", "passed": tr')
    with pytest.raises(Exception, match="(?i)malformed"):
        gates.read_evidence(spark, [f"file://{tmp_path}/cut.json"]).collect()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id":"a","raw_completion":"[]"}\n{"id":"b","raw_completion":"["}\n')
    truth = spark.createDataFrame([("a", []), ("b", [])], "id string, targets array<array<int>>")
    out = f"file://{tmp_path}/out"
    for _ in range(2):  # a second run finds nothing new
        incremental.write_stream(incremental.score_stream(incremental.arriving(spark, f"file://{tmp_path}/in"), truth), out, f"file://{tmp_path}/state").awaitTermination()
    assert {r["id"]: r["reward"] for r in spark.read.parquet(out).collect()} == {"a": 1.0, "b": 0.0}
