import hashlib

import xxhash
from pyspark.sql import functions as F

from boxloom.llm import syncmers

SCHEMA = "doc_id long, text string"


def chained(values, seed=42):
    """XXH64 of several longs or byte strings, each hash being the next one's seed."""
    for v in values:
        data = v if isinstance(v, bytes) else (v % 2**64).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def brute(text, k=12, s=8, bins=64):
    if not text:
        hashes = set()
    elif len(text) < k:
        hashes = {chained([text.encode()])}
    else:
        smers = [signed(chained([text[i : i + s].encode("utf-32-be")])) for i in range(len(text) - s + 1)]
        hashes = set()
        for i in range(len(text) - k + 1):
            inner = smers[i : i + k - s + 1]
            if min(inner) in (inner[0], inner[-1]):
                hashes.add(chained([inner[0], inner[-1]]))
    marks = {}
    for h in hashes:
        j, v = h % bins, h >> 32
        marks[j] = min(v, marks.get(j, v))
    return sorted(j << 32 | v for j, v in marks.items())


def alike(a, b):
    full = {m >> 32 for m in a} | {m >> 32 for m in b}
    return len(set(a) & set(b)) / len(full) if full else 1.0


def show(marks):
    return "".join(f"{m:010x}" for m in marks)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_at", F.lit("x")).withColumn("n_chars", F.lit("y"))
    got = sorted((tuple(r) for r in syncmers.with_edits(df).collect()), key=str)
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(chained([r[1].encode()]))))
    want = []
    for at, (doc_id, text) in enumerate(rows):
        after, m = rows[(at + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - m] + after[:m]
        a, b, c = brute(text), brute(edited), brute(after)
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(b), alike(a, b), alike(a, c)))
    assert got == sorted(want, key=str)


def test_against_brute_force(spark, monkeypatch):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60").select("doc_id", "text").collect()]
    docs += [(100, None), (101, ""), (102, "x"), (103, "short"), (104, "日本語のテキスト、𝒳𝒴 長い長い"), (105, "ab" * 4000), (106, "same text here, twice"), (106, "same text here, twice"), (106, "other text here"), (None, "no id")]
    check(spark, docs)
    monkeypatch.setattr(syncmers, "BUCKET", 7)
    check(spark, docs)


def test_small_tables(spark):
    check(spark, [(7, "only one document, its own next one")])
    assert syncmers.with_edits(spark.createDataFrame([], SCHEMA)).collect() == []


def test_fingerprints_and_anchors(spark):
    df = spark.createDataFrame([(1, "a passage that is long enough to have anchors"), (2, "lead: a passage that is long enough to have anchors"), (3, None)], SCHEMA)
    prints = {r["doc_id"]: r["marks"] for r in syncmers.fingerprints(df).collect()}
    assert prints[1] == brute("a passage that is long enough to have anchors") and prints[3] == []
    places = {}
    for r in syncmers.anchors(df, "text", ["doc_id"]).collect():
        places.setdefault(r["hash"], {})[r["doc_id"]] = r["pos"]
    moved = {p[2] - p[1] for p in places.values() if len(p) == 2}
    assert moved == {6}  # the shared passage's anchors stand at one offset


def test_query_takes_s_of_six(spark):
    from boxloom.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40).collect()
    got = {r["doc_id"]: r["fingerprint"] for r in queries.op2_syncmers(spark, "/root/testdata/sf0.001").collect()}
    assert all(got[r["doc_id"]] == show(brute(r["text"], s=6)) for r in docs)
