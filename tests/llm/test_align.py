"""Alignment against a token-by-token version on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boxloom.llm import align
from boxloom.llm.tokens import _byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(texts):
    """(id, bytes) lists of both sides for each text; nothing if either does not give the text back."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = {c: i for i, c in enumerate(_byte_letters())}
    for text in texts:
        said = (" " + (text or "")).encode()
        left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(said.decode(), add_special_tokens=False).ids] if text else []
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)] if text else []
        yield (left, right) if all(b"".join(x for _, x in side) == said for side in (left, right)) else ([], [])


def ranges(side):
    at = 0
    for i, said in side:
        yield i, at, at + len(said)
        at += len(said)


def by_hand(docs):
    linked, shown = [], []
    for left, right in tokens(text for _, text, *_ in docs):
        a, b = list(ranges(left)), list(ranges(right))
        linked.append([(i, j) for i, s, e in a for j, t, f in b if s < f and t < e])
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        parts = [[",".join(str(i) for i, s, e in side if lo < e <= hi) for side in (a, b)] for lo, hi in zip([0, *cuts], cuts, strict=False)]
        shown.append((len(a), len(b), len(cuts), ";".join("|".join(p) for p in parts)))
    count = Counter(p for links in linked for p in set(links))
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    return sorted(
        ((d[0] is None, d[0] or 0), *s[:3], len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), s[3]) for d, s, links in zip(docs, shown, linked, strict=True)
    )


def told(spark, docs, per_block=None, monkeypatch=None):
    frame = spark.createDataFrame(docs, "doc_id long, text string, pair string, block long").repartition(3)
    found = align.aligned(frame, A, B)
    rows = align.with_counts(found, align.piece_ids(B)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    return sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in rows)


ODD = [
    None, "", " ", "  ", "a", "a ", " a", "a  b", "\n", "tab\tx\r\ny\xa0z", "<|endoftext|> <s>a</s><unk> <0x41>", "a▁b", "▁", "ﬁ Å Å é é", "😀​👩‍💻  ",
    "日本語の テキスト", "\x00\x01", "x" * 300, "don't we'll  I'm\n\n  ok", "1234567 89,10.5", "Ünïcödé ßtraße", " \n a \n  b",
]


def test_same_as_token_by_token(spark):
    rng = random.Random(3)
    signs = ["a", "the", " ", " ", "  ", "\n", "'s", "é", "ß", "7", ",", "<s>", "日", "😀", "▁", "tion", "<|endoftext|>"]
    docs = [(i, t, "p", 5) for i, t in enumerate(ODD)] + [(100 + i, "".join(rng.choices(signs, k=rng.randint(1, 40))), None, None) for i in range(120)]
    docs += [(None, "the cat", "", 1), (None, None, "", 1), (7, "the cat", "", 1), (7, "the cat", "", 1)]
    assert told(spark, docs) == by_hand(docs)


def test_long_texts_and_many_blocks(spark, monkeypatch):
    words = "the quick brown Fox jumps över 12 lazy dogs, don't it?".split()
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(words, k=50)), "", 0) for i in range(60)]
    assert told(spark, docs) == by_hand(docs)
    long = " ".join(rng.choices(words, k=60_000))
    (row,) = told(spark, [(1, long, "", 0)])
    (left, right), ends = next(tokens([long])), [set(), set()]
    for k, side in enumerate((left, right)):
        ends[k] = {e for _, _, e in ranges(side)}
    assert row[1:5] == (len(left), len(right), len(ends[0] & ends[1]), len(ends[0] | ends[1]))


def test_empty_table(spark):
    assert told(spark, []) == []


def test_groups_as_rows(spark):
    found = align.aligned(spark.createDataFrame([(1, "naïve tokenization"), (2, None)], "doc_id long, text string"), A, B)
    rows = align.token_groups(found).orderBy("place").collect()
    assert {r["doc_id"] for r in rows} == {1} and [r["place"] for r in rows] == list(range(len(rows)))
    assert ";".join(",".join(map(str, r["a"])) + "|" + ",".join(map(str, r["b"])) for r in rows) == found.where("doc_id = 1").first()["groups"]


@pytest.mark.parametrize("size", [1, 64, 65, 500])
def test_bitsets(size):
    rng = np.random.default_rng(size)
    marks = [np.flatnonzero(rng.random(size) < 0.3) for _ in range(2)]
    a, b = (align.BitSet.of(m, size) for m in marks)
    assert set((a & b).select()) == set(marks[0]) & set(marks[1]) and set((a | b).select()) == set(marks[0]) | set(marks[1])
    assert a.rank(np.arange(size + 1)).tolist() == [int((marks[0] < p).sum()) for p in range(size + 1)]


def test_query_digest(spark):
    from boxloom.llm.queries import op12_alignment

    rows = op12_alignment(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 10_000_000).alias("text"))
    want = {r[0][1]: (r[4], r[5], r[6], hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "") for r in by_hand([tuple(r) for r in docs.where("length(text) < 1500").collect()])}
    shown = {r["doc_id"]: (r["n_links"], r["groups_sha256"]) for r in rows}
    assert len(shown) == len(rows) == docs.count()
    assert {i: (w[0], w[3]) for i, w in want.items()} == {i: shown[i] for i in want}
