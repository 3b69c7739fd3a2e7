import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from boxloom.llm import language

SCHEMA = "doc_id long, text string, lang string"


def phrases(text, model, k):
    """The parse by definition: longest prefixes that occur in the sample."""
    known = model.samples[k]
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in known:
            n += 1
        count, at = count + 1, at + n
    return count


def test_phrase_counts_by_definition():
    rng = random.Random(2)
    rows = [(lang, "".join(rng.choice(letters) for _ in range(400))) for lang, letters in (("x", "abcd "), ("y", "cdefé"))]
    model = language.Model(rows)
    model.samples = []
    for lang in model.languages:
        coded = model.map[language._points(" " + dict(rows)[lang])]
        model.samples.append("".join(chr(65 + c) for c in coded if c > 0))
    for _ in range(60):
        text = "".join(rng.choice("abcdefé q") for _ in range(rng.randrange(1, 90)))
        coded = model.map[language._points(text)]
        got = model.phrases(coded[:, None], np.array([len(coded)]))[:, 0]
        shown = "".join(chr(65 + c) for c in coded)
        assert [phrases(shown, model, k) for k in range(2)] == got.tolist()


def test_windows_add_up():
    rows = [("x", "the cat sat on the mat " * 20), ("y", "der hund lag auf dem tisch " * 20)]
    model = language.Model(rows)
    names, scores = model.judge(["the cat " * 5000, "der hund " * 3, None, "", "123 !", "É"])
    assert names == ["x", "y", "und", "und", "und", names[5]] and scores[0] > 0.5 and all(0 <= s <= 1 for s in scores)


def test_held_out_accuracy_and_inputs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r["doc_id"]: r for r in language.identify(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert all(out[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if out[r["doc_id"]]["held_out"]]
    assert sum(out[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    swapped = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    again = {r["doc_id"]: r["lang_pred"] for r in language.identify(swapped).collect()}
    assert all(again[k] == r["lang_pred"] for k, r in out.items())


def test_defined_cases(spark):
    rows = [(i, "plain words of one tongue", "en") for i in range(8)] + [(None, "x", "en"), (50, None, "en"), (51, "", None), (52, "12 34", "en"), (53, "words of", None), (0, "again", "en")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pick", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("bucket", F.lit(0))
    out = language.identify(df).collect()
    assert len(out) == len(rows)
    assert {r["doc_id"]: r["lang_pred"] for r in out if r["doc_id"] in (50, 51, 52, 53)} == {50: "und", 51: "und", 52: "und", 53: "en"}
    assert language.identify(df.limit(0)).collect() == []
    assert {r["lang_pred"] for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_a_worker_holds_little_beside_its_texts():
    """Workers share an executor's memory: short texts with a long one among them are no wide arrays, and tables have no columns without use."""
    model = language.Model([("x", "the cat sat on the mat " * 20), ("y", "der hund lag auf dem tisch " * 20)])
    assert model.classes == 2 + len(set("thecatsatonthematderhundlagaufdemtisch"))
    texts = pa.array(["the cat sat"] * 80_000 + ["the cat " * 60])
    tracemalloc.start()
    try:
        names, _ = model.judge(texts)
        assert tracemalloc.get_traced_memory()[1] < 80 << 20
    finally:
        tracemalloc.stop()
    assert len(names) == 80_001 and set(names) == {"x"}


def test_a_batch_is_not_made_python_strings_at_once():
    model = language.Model([("x", "the cat sat on the mat " * 20), ("y", "der hund lag auf dem tisch " * 20)])
    one, many = (pa.array(["the cat sat on the mat " * 400] * n) for n in (200, 4000))
    peaks = []
    for texts in (one, many):
        tracemalloc.start()
        try:
            model.judge(texts)
            peaks.append(tracemalloc.get_traced_memory()[1])
        finally:
            tracemalloc.stop()
    assert peaks[1] < peaks[0] + (4 << 20)


def test_a_worker_lets_go_of_what_an_earlier_stage_needed():
    import public_tokenizers

    from boxloom.llm import text, tokens

    rows = (("x", "the cat"), ("y", "der hund"))
    tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    model = language._model(rows)
    assert language._model(rows) is model and list(text._held["languages"].values()) == [model] and not text._held["tokenizers"]
    tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not text._held["languages"]
