import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from boxloom.llm import shingles, simhash
from boxloom.llm.simhash import near_copies, near_duplicates, near_links

SCHEMA = "doc_id long, text string"


def brute(texts, shingle=3, radius=2):
    prints = []
    for text in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return prints, label


def rows_of(df):
    return {r["doc_id"]: (r["w0"] % 2**64, r["component_id"]) for r in df.collect()}


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    texts = [r["text"] for r in docs]
    rng = np.random.default_rng(1)
    for text in texts[:60]:  # near copies: one word changed
        parts = text.split(" ")
        parts[int(rng.integers(len(parts)))] = "changed"
        texts.append(" ".join(parts))
    texts += [None, "", " \t\n", "one", "One", "one two", "A" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    prints, label = brute(texts)
    got = rows_of(near_duplicates(df))
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[i] == (prints[i], label[i])


def labels_of(marks, radius):
    label = list(range(len(marks)))
    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= radius and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_search_is_exact_in_dense_clusters(spark, radius):
    rng = np.random.default_rng(2)
    marks = {int(rng.integers(2**62))}
    while len(marks) < 300:
        some = list(marks)[int(rng.integers(len(marks)))]
        marks.add(some ^ (1 << int(rng.integers(62))) ^ (1 << int(rng.integers(62))))
    marks |= {int(x) for x in rng.integers(2**62, size=300)}
    marks = sorted(marks)
    df = spark.createDataFrame([(0, i, m) for i, m in enumerate(marks)] + [(1, 10_000 + i, m ^ 1) for i, m in enumerate(marks[:50])], "kind int, rep long, key long")
    links = [(r["src"], r["dst"]) for r in near_links(df, radius).collect()]
    assert all((a < 10_000) == (b < 10_000) for a, b in links)  # kinds never meet
    got = list(range(len(marks)))
    for x, y in links:
        if x < 10_000 and got[x] != got[y]:
            a, b = sorted((got[x], got[y]))
            got = [a if v == b else v for v in got]
    assert got == labels_of(marks, radius)
    assert len(links) < len(simhash.orders(radius)) * (len(marks) + 50)


def test_index_leaves_groups_and_splits_large_searches(monkeypatch):
    rng = np.random.default_rng(3)
    keys = rng.integers(2**63, size=4000).astype(np.uint64)
    keys = np.unique(np.concatenate((keys, keys[:500] ^ np.uint64(1 << 40), keys[:200] ^ np.uint64(5))))
    ranks = keys.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        ranks ^= ranks >> np.uint64(shift)
    keys = keys[np.argsort(ranks)]
    far = np.bitwise_count(keys[:, None] ^ keys[None, :])
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(far <= 2, 1)), strict=True)}
    for block in (1 << 20, 1 << 12):
        monkeypatch.setattr(simhash, "BLOCK", block)
        found = [x for a, b in simhash.GrayIndex(keys, 2).pairs() for x in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(found) == len(set(found)) and set(found) == want
    # of 4700 keys a descent meets few
    index = simhash.GrayIndex(keys, 2)
    met = sum(np.count_nonzero(np.bitwise_count((keys[i] ^ index.levels[0][0]) & index.levels[0][1]) <= 2) for i in range(0, len(keys), 100))
    assert met < 0.2 * 47 * len(index.levels[0][0])


def test_defined_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).collect() == []
    df = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (7, "other words entirely here")], SCHEMA)
    df = df.withColumn("component_id", F.lit("clash")).withColumn("_row", F.lit(0)).withColumn("w0", F.lit("x"))
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in near_duplicates(df).collect())
    assert got == [(0, 5), (5, 5), (5, 5), (7, 7)]


def _jaccard_labels(texts):
    sets = []
    for text in texts:
        words = text.split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def _pairs(rng, shares, words=120):
    """For each share, a text and one whose last words differ, so that about that share of the shingles is common."""
    texts = []
    for share in shares:
        one = [f"w{rng.integers(10**9)}" for _ in range(words)]
        keep = round((words - 4) * 2 * share / (1 + share)) + 4
        texts += [" ".join(one), " ".join(one[:keep] + [f"v{rng.integers(10**9)}" for _ in range(words - keep)])]
    return texts


def test_copies_are_alike_on_both_sides(spark):
    rng = np.random.default_rng(5)
    # short texts: four shingles against five have a similarity of 0.8
    short = [" ".join(f"s{rng.integers(10**9)}" for _ in range(9)) for _ in range(60)]
    texts = _pairs(rng, [0.8, 0.81, 0.82, 0.83] * 40 + [0.7, 0.75, 0.78, 0.79] * 40) + [x for t in short for x in (t, t.rsplit(" ", 1)[0])]
    # one shingle repeated counts once
    lead = " ".join(f"r{i}" for i in range(60))
    texts += [lead, lead + " same same same same same" + " same" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in near_copies(df).collect()}
    want = dict(enumerate(_jaccard_labels(texts)))
    wrong = [i for i in want if got[i] < want[i]]
    assert wrong == []  # nothing below 0.8 is linked
    assert got == want  # nor is anything lost


def test_recall_at_the_threshold(spark):
    """Of 1200 pairs at 0.8 and a little above, by brute force over their sets, all but a few in a thousand are linked; none below."""
    rng = np.random.default_rng(9)
    texts = _pairs(rng, [0.8, 0.8, 0.805, 0.81] * 300 + [0.79] * 200, words=80)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in near_copies(df).collect()}
    want = dict(enumerate(x for i in range(0, len(texts), 2) for x in (i + y for y in _jaccard_labels(texts[i : i + 2]))))
    pairs = [i for i in want if want[i] < i]
    assert len(pairs) > 1000
    found = [i for i in pairs if got[i] == want[i]]
    assert len(found) >= 0.99 * len(pairs)
    assert all(got[i] == i for i in want if want[i] == i)


def test_large_group_is_cut_into_blocks(spark):
    rng = np.random.default_rng(6)
    lead = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(80):
        words = list(lead)
        for at in rng.integers(200, size=4):
            words[at] = f"x{rng.integers(10**9)}"
        texts.append(" ".join(words))
    texts += _pairs(rng, [0.9, 0.6] * 10)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in near_copies(df, block=8).collect()}
    assert got == dict(enumerate(_jaccard_labels(texts)))


def test_shingle_sets_of_texts():
    texts = [None, "", " \t\n", "one", "One", "one two", "a b c d e f", "a b c d e a b c d e", "x" * 5000, "é ü\xa0y", "A b C d E"]
    sets = shingles.shingle_sets(pa.array(texts), 5)
    assert sets.sizes.tolist() == [0, 0, 0, 1, 1, 1, 2, 5, 1, 1, 1]
    assert sets[3].tolist() == sets[4].tolist() != sets[5].tolist()
    assert sets[10][0] in sets[6]
    # the same wherever a text stands in its slice
    assert all(shingles.shingle_sets(pa.array([t]), 5)[0].tolist() == sets[i].tolist() for i, t in enumerate(texts))
    assert np.array_equal(simhash.copy_words(sets)[8], simhash.copy_words(shingles.shingle_sets(pa.array([texts[8]]), 5))[0])


def test_without_copies(spark):
    long_ = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, "a b c d e f", "x"), (5, "a b c d e f", "x"), (None, "a b c d e f", "y"), (None, "only a null id has this", "z"), (3, "other words entirely stand here", "x"), (3, long_, "x"), (9, long_ + " more", "x"), (1, None, "x"), (2, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, t0 string").withColumn("g0", F.lit(1)).withColumn("node", F.lit(1)).withColumn("own", F.lit(1))
    kept = simhash.without_copies(df)
    assert kept.columns == df.columns
    got = sorted((r["doc_id"] or 0, r["text"], r["t0"]) for r in kept.collect())
    assert [(i, x) for i, _, x in got] == [(0, "z"), (1, "x"), (3, "x"), (3, "x"), (5, "x")]
    empty = df.where("false")
    assert simhash.without_copies(empty).collect() == [] and near_copies(empty).collect() == []


def test_texts_sent_are_in_proportion_to_a_group(spark, monkeypatch):
    """A group of near copies among texts that only look alike; every text is sent a few times, however large the group."""
    rng, sent, links = random.Random(12), [], simhash._links

    def counted(met, places, shingle):
        sent.append(met.select(F.explode(places)).count())
        return links(met, places, shingle)

    monkeypatch.setattr(simhash, "_links", counted)
    lead = [f"w{rng.randrange(900)}" for _ in range(120)]
    for n in (96, 384):
        swapped = [rng.randrange(120) for _ in range(n)]  # one word each: any two copies have 0.84 in common
        copies = [" ".join(f"x{i}" if k == at else w for k, w in enumerate(lead)) for i, at in enumerate(swapped)]
        docs = [(i, t) for i, t in enumerate(copies)] + [(10_000, "a text apart from all of them in every word"), (10_001, None)]
        sent.append(0)
        found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), block=16).collect()}
        assert all(found[i] == 0 for i in range(n)) and found[10_000] == 10_000
    first, then = sent[1 : sent.index(0, 1)], sent[sent.index(0, 1) + 1 :]
    assert len(first) > 1 and sum(then) < 6 * sum(first)
