"""The filter audit against a document-by-document walk through every order."""

from itertools import permutations

import pytest

from boxloom.llm import audit

DOCS = "doc_id long, text string, source string, mask long, part string"
LABELS = "doc_id long, quality int, toxic int"


def fails(text: str, copy: bool) -> dict[str, bool]:
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": copy,
    }


def by_hand(docs, labels):
    good, toxic = ({i for i, *flags in labels if flags[k] == 1 and i is not None} for k in (0, 1))
    least, out = {}, {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    told = [(part or "", i, fails(text or "", i is not None and i > least[text or ""])) for i, text, part, *_ in docs]
    for part in {p for p, _, _ in told}:
        mine = [(i, f) for p, i, f in told if p == part]
        totals = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                here = [(i, f) for i, f in left if f[x]]
                left = [(i, f) for i, f in left if not f[x]]
                failing = [f for _, f in mine if f[x]]
                totals[x] += len(here)
                out[part, order, step] = [
                    len(left), len(here), len(failing) - len(here), sum(sum(f.values()) == 1 for f in failing), sum(i in good for i, _ in here), sum(i in toxic for i, _ in here),
                ]
        for key in out:
            if key[0] == part:
                out[key].append(totals[key[1][key[2] - 1]])
    return out


def told(frame):
    rows = [tuple(r) for r in frame.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()]
    found = {r[:3]: list(r[3:]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_same_as_walking_every_order(spark):
    plain = " ".join(f"w{i}" for i in range(60))
    texts = [plain, plain.upper(), "a b c", "", None, plain + " #", "x " * 80, plain + "\x0b\x0c" + plain, "É" * 30 + " ok", plain.replace(" ", " "), "long " * 40_000]
    docs = [(i, texts[i % len(texts)], ["s", "t", None, ""][i % 4], 7, "z") for i in range(44)]
    docs += [(3, texts[3], "s", 7, "z"), (3, texts[3], "t", 7, "z"), (0, plain, "s", 7, "z"), (None, plain, "s", 7, "z"), (None, None, None, 7, "z"), (None, plain + " #", "t", 7, "z")]
    labels = [(0, 1, 0), (0, 0, 1), (5, 1, None), (6, None, 1), (3, 1, 1), (None, 1, 1), (99, 1, 1), (11, 1, 1), (22, 0, 0), (17, 1, 1), (17, 1, 1)]
    found = told(audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)))
    assert found == by_hand(docs, labels)


def test_copies_that_most_documents_share(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, concat('t', id), 'all the same') AS text", "concat('s', id % 2) AS source", "id AS mask", "id AS part")
    found = told(audit.audit(docs, spark.createDataFrame([], LABELS)))
    assert sum(v[1] for (_, order, step), v in found.items() if order == "EABCD" and step == 1) == 1999
    assert {k[0] for k in found} == {"s0", "s1"}


@pytest.mark.parametrize("of", ["documents", "labels"])
def test_empty_tables(spark, of):
    docs = spark.createDataFrame([] if of == "documents" else [(1, "a", "s", 0, "")], DOCS)
    found = told(audit.audit(docs, spark.createDataFrame([], LABELS)))
    assert len(found) == (0 if of == "documents" else 600)


def test_own_filters(spark):
    texts = audit.measured(spark.createDataFrame([(1, "ab", "s", 0, ""), (2, "ab", "s", 0, ""), (3, "b", "s", 0, "")], DOCS))
    found = audit.interactions(audit.cells(texts, spark.createDataFrame([], LABELS), {"x": texts["_text"].contains("a")}), "xc")
    assert {tuple(r) for r in found.select("filter_order", "step", "removed", "redundant", "shapley").collect()} == {("xc", 1, 2, 0, 3), ("xc", 2, 0, 1, 1), ("cx", 1, 1, 0, 1), ("cx", 2, 1, 1, 3)}
