"""Sealed folders, gate rules and events of runs."""

import json

import pytest
from pyspark.sql import functions as F

from boxloom.errors import ArtifactError, DataError
from boxloom.functions.sizes import resized, visual_tokens
from boxloom.plans import artifacts, gates, runs
from boxloom.streaming import runs as followed

TERMS = artifacts.contracted({"grid": 1000, "name": "é"})
SHAPE = artifacts.Topology({"r": 16}, frozenset({"a", "b"}))


@pytest.fixture
def adapter(tmp_path):
    folder = tmp_path / "adapter"
    folder.mkdir()
    (folder / artifacts.WEIGHTS).write_bytes(b"weights")
    (folder / artifacts.SETTINGS).write_text(json.dumps({"r": 16, "target_modules": ["b", "a"]}))
    return folder


def test_seal_and_unseal(spark, adapter, tmp_path):
    made = artifacts.seal(spark, f"file://{adapter}", f"file://{tmp_path}/one", TERMS, SHAPE, {"stage": "base"})
    found = artifacts.unseal(spark, f"file://{tmp_path}/one", TERMS, SHAPE)
    assert found == made and found.seal == made.seal and set(found.files) == {artifacts.WEIGHTS, artifacts.SETTINGS, artifacts.CONTRACT}
    with pytest.raises(ArtifactError, match="differ"):
        artifacts.unseal(spark, f"file://{tmp_path}/one", artifacts.contracted({"grid": 999, "name": "é"}), SHAPE)
    with pytest.raises(ArtifactError, match="modules"):
        artifacts.unseal(spark, f"file://{tmp_path}/one", TERMS, artifacts.Topology({"r": 16}, frozenset({"a"})))


@pytest.mark.parametrize("change", ["weights", "more", "less", "card"])
def test_what_changed_is_refused(spark, adapter, tmp_path, change):
    artifacts.seal(spark, f"file://{adapter}", f"file://{tmp_path}/one", TERMS, SHAPE, {"stage": "base"})
    folder = tmp_path / "one"
    for f in folder.glob(".*.crc"):
        f.unlink()
    if change == "weights":
        (folder / artifacts.WEIGHTS).write_bytes(b"other")
    elif change == "more":
        (folder / "optimizer.bin").write_bytes(b"x")
    elif change == "less":
        (folder / artifacts.SETTINGS).unlink()
    else:
        ledger = json.loads((folder / artifacts.LEDGER).read_text())
        (folder / artifacts.LEDGER).write_text(json.dumps(ledger | {"card": {"stage": "tuned"}}))
    with pytest.raises(ArtifactError, match="not what was sealed"):
        artifacts.unseal(spark, f"file://{folder}", TERMS, SHAPE)


def test_incomplete_adapters(spark, adapter, tmp_path):
    (adapter / artifacts.WEIGHTS).unlink()
    with pytest.raises(ArtifactError, match="lacks"):
        artifacts.seal(spark, f"file://{adapter}", f"file://{tmp_path}/one", TERMS, SHAPE, {})
    assert not (tmp_path / "one").exists()


def test_gate_rules(spark):
    good = {"peak_reserved_gib": 44.0, "positive_completion": '[{"bbox_2d":[1,1,5,5]}]', "negative_completion": "[]", "offline": True, "artifact": "abc", "other": None}
    rules = gates.hardware_rules(spark, {"artifact": "abc"})
    cases = [
        ("H1", good, []),
        ("H2", good | {"peak_reserved_gib": 44.1, "negative_completion": "```[]```"}, ["negative_completion is no detection set", "peak_reserved_gib is not at most 44.0"]),
        ("D1", good | {"world_size": 1, "offline": False, "loss": float("nan")}, ["loss is not finite", "offline is not true", "world_size is not at least 2"]),
    ]
    facts = None
    for gate, document, _ in cases:
        part = gates.facts_of(spark, gate, document)
        facts = part if facts is None else facts.unionByName(part)
    found = {r["gate"]: (r["passed"], r["faults"]) for r in gates.judged(rules, facts).collect()}
    assert found == {gate: (not faults, faults) for gate, _, faults in cases}
    empty = gates.judged(rules, gates.facts_of(spark, "H1", {"artifact": "other"})).first()
    assert len(empty["faults"]) == 5 and "artifact is not abc" in empty["faults"]
    report = gates.judged(gates.report_rules(spark), gates.facts_of(spark, "evaluation", dict.fromkeys(gates.PROVENANCE, "h"))).first()
    assert report["passed"]


def test_checkpoints_and_ranks(spark):
    listed = spark.createDataFrame([("a", "checkpoint-3", True), ("a", "checkpoint-10", True), ("a", "checkpoint-12", False), ("a", "best", True), ("b", "checkpoint-1", False)], "run string, folder string, complete boolean")
    assert [tuple(r) for r in runs.complete_steps(listed).collect()] == [("a", 10)]
    with pytest.raises(Exception, match="two checkpoints in a"):
        runs.complete_steps(listed.unionByName(listed.selectExpr("run", "'checkpoint-0010' AS folder", "complete"))).collect()
    ranks = spark.createDataFrame([(0, 1.5, True, False), (1, 2.5, False, None)], "rank int, peak_gib double, seen_positive boolean, seen_negative boolean")
    assert tuple(runs.over_ranks(ranks).first()) == (2, 2.5, True, False)
    events = spark.createDataFrame([("x", True, 0.1), ("x", True, 0.3), ("y", False, 0.2), ("y", False, 0.2)], "id string, positive boolean, reward double")
    assert tuple(runs.kinds_seen(events).first()) == (4, True, True, 1)
    runs.require_kinds(runs.kinds_seen(events))
    with pytest.raises(DataError):
        runs.require_kinds(runs.kinds_seen(events.where("positive")))


def event(run, kind, **fields):
    names = ["run", "kind", "identity", "step", "folder", "complete", "id", "positive", "reward"]
    return tuple(({"run": run, "kind": kind} | fields).get(n) for n in names)


FIRST = [
    event("a", "start", identity="x"), event("a", "checkpoint", step=3, folder="f3", complete=True), event("a", "checkpoint", step=5, folder="f5", complete=False),
    event("a", "reward", id="i", positive=True, reward=0.5), event("b", "start", identity="y"), event("b", "checkpoint", step=2, folder="f2", complete=True),
    event("c", "reward", id=None, positive=True, reward=1.0), event("c", "rest"), event("c", "checkpoint", folder="f", complete=True),
]
THEN = [
    event("a", "reward", id="i", positive=False, reward=0.7), event("a", "start", identity="x"), event("a", "checkpoint", step=4, folder="f4", complete=True),
    event("b", "start", identity="z"), event("b", "checkpoint", step=2, folder="g2", complete=True), event("d", "checkpoint", step=1, folder="f1", complete=True), event("d", "checkpoint", step=1, folder="g1", complete=True),
]
KNOWN = {"a": (4, "ready", 2, True, True, 1), "b": (2, "refused", 0, False, False, 0), "c": (None, "open", 0, False, False, 0), "d": (1, "ambiguous", 0, False, False, 0)}


def told(rows):
    return {r["run"]: (r["step"], r["status"], r["rewards"], r["positive"], r["negative"], r["uneven_ids"]) for r in rows}


def test_runs_from_a_table(spark):
    assert told(followed.follow(spark.createDataFrame([*FIRST, *THEN], followed.EVENT)).collect()) == KNOWN


def test_runs_from_a_stream_that_restarts(spark, tmp_path):
    heard = {}

    def hear(batch, _):
        heard.update(told(batch.collect()))

    for part in (FIRST, THEN):  # each pass is a new query on the same checkpoint
        spark.createDataFrame(part, followed.EVENT).coalesce(1).write.mode("append").json(str(tmp_path / "events"))
        stream = followed.follow(spark.readStream.schema(followed.EVENT).json(str(tmp_path / "events")))
        query = stream.writeStream.outputMode("update").foreachBatch(hear).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(180)
        if part is FIRST:
            assert heard["a"] == (3, "ready", 1, True, False, 0) and heard["b"][1] == "ready"
    assert heard == KNOWN


def test_resized(spark):
    import math

    def by_rule(w, h):
        near = lambda x: round(x / 32) * 32
        nw, nh = near(w), near(h)
        if nw * nh > 655_360:
            beta = math.sqrt(w * h / 655_360)
            return max(32, math.floor(w / beta / 32) * 32), max(32, math.floor(h / beta / 32) * 32)
        if nw * nh < 65_536:
            beta = math.sqrt(65_536 / (w * h))
            return math.ceil(w * beta / 32) * 32, math.ceil(h * beta / 32) * 32
        return nw, nh

    sizes = [(260, 2600), (325, 2080), (1, 1), (1, 200), (2, 401), (48, 80), (3000, 3000), (0, 5)] + [(w, h) for w in range(20, 3000, 61) for h in range(20, 3000, 59)]
    rows = spark.createDataFrame(sizes, "w int, h int").select("w", "h", resized(F.col("w"), F.col("h")).alias("s"), visual_tokens(resized(F.col("w"), F.col("h"))).alias("n")).collect()
    for r in rows:
        w, h = r["w"], r["h"]
        want = None if min(w, h) <= 0 or max(w, h) / min(w, h) > 200 else by_rule(w, h)
        assert (r["s"] and tuple(r["s"])) == want and r["n"] == (want and want[0] * want[1] // 1024)
