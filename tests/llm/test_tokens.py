import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boxloom.llm import packing, records
from boxloom.llm.tokens import UnitEncoder

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string"
_made = {p: UnitEncoder(p) for p in (BYTES, WORDS)}
_plain = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}

ODD = ["", " ", "a b", "a  b", " lead", "trail ", "tab\tx", "a\t b", "a \n b", "nbsp\xa0 x", "x  y", "<|endoftext|> x", "x <|endoftext|> y", "a<|startoftext|>b <|ENDOFTEXT|>", "2×3 ÷ é×", "a,\n\nb\nc", "\n", ".\nB", "a-b_c 12.5%", "É ÀÇ ê", "é ́x", "I'll we've 'S 12345", "\x00 a", "\x1c \x1d", "日本 語　 x", "a" * 3000, "ΑΣ σΑΣ "]


def same(texts):
    for path, enc in _made.items():
        ids, at = enc.encode(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == _plain[path].encode(text or "", add_special_tokens=False).ids, (path, text)


def test_units_give_the_tokenizers_ids():
    assert _made[BYTES].cut == "kept" and _made[WORDS].cut == "dropped"
    same(ODD + [None])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\x85\xa0 ab'1É́ſσΣ"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=6))
def test_units_on_any_text(texts):
    same(texts)


def bfd(lengths, size):
    """Best-fit decreasing, one piece after the other."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(size - n)
    return len(room), sorted(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    size = 40
    histogram = {n: lengths.count(n) for n in set(lengths)}
    filled = {}
    for length, _, n, per, first, offset in packing.plan(histogram, size):
        for i in range(n):
            bin_, at = first + i // per, offset + i % per * length
            assert filled.get(bin_, 0) == at
            filled[bin_] = at + length
    bins, rooms = bfd(lengths, size)
    assert len(filled) == bins and sorted(size - x for x in filled.values()) == rooms


def test_packing_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 3000), (None, "null id"), (-3, "word " * 3000)], SCHEMA)
    docs = docs.unionByName(extra).withColumn("offset", F.lit("clash")).withColumn("length", F.lit(1))
    placed = packing.best_fit(docs, BYTES, size=256, with_ids=True)
    rows = placed.collect()
    fits = {}
    for r in rows:
        fits.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4"))
    for parts in fits.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(fits) == bfd([r["length"] for r in rows], 256)[0]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in texts.items():
        if doc_id == -3:
            continue
        parts = sorted(by[doc_id], key=lambda r: r["piece"])
        ids = [i for r in parts for i in r["ids"]]
        assert ids == _plain[BYTES].encode(text or "", add_special_tokens=False).ids + [2]
        assert [r["start"] for r in parts] == list(np.cumsum([0] + [r["length"] for r in parts])[:-1])
        assert all(r["length"] == 256 for r in parts[1:])
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(placed).collect()}
    assert all(whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"] for r in rows)


def test_packing_empty(spark):
    assert packing.best_fit(spark.createDataFrame([], SCHEMA), BYTES).collect() == []


def test_records_round_trip(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (5_000_000_000, ""), (None, "null id"), (77, "again")], SCHEMA)).withColumn("ids", F.lit(1))
    manifest = records.write_records(docs, f"file://{tmp_path}/r", WORDS, parts=3)
    got = {(r["doc_id"], r["n_tokens"], r["ids_crc32"]): r["start"] for r in records.read_digests(manifest).collect()}
    start = 0
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    assert len(got) == len(rows)
    for r in rows:
        ids = np.array(_plain[WORDS].encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        assert got[(r["doc_id"], len(ids), zlib.crc32(ids))] == start
        start += len(ids)
    files = [r["file"] for r in manifest.collect()]
    once, twice = (sorted((d or -9, i.tobytes()) for d, i in records.shuffled(files, seed)) for seed in (1, 2))
    assert once == twice and len(once) == len(rows)


def test_records_wide_ids_and_damage(spark, tmp_path):
    import io

    ids = np.array([1, 70000], np.uint32)
    data = records.frame(3, ids)
    doc, back = records.unframe(io.BytesIO(data))
    assert doc == 3 and back.tolist() == [1, 70000]
    for at in (0, 9, 15, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(io.BytesIO(bytes(bad)))
    empty = records.write_records(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/e", WORDS, parts=2)
    assert records.read_digests(empty).collect() == []
