import hashlib
import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from boxloom.llm import pii

SCHEMA = "doc_id long, text string"


def run(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumn("entities", F.lit("clash")).withColumn("_e", F.lit(1))
    out = pii.pseudonymize(df, key).orderBy("doc_id").collect()
    return [r["text"] for r in out], [[tuple(e) for e in r["entities"]] for r in out]


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def shape(text):
    """Each character's class (vowels and consonants told apart), or itself where it has none."""
    return [next((k for k, letters in enumerate(pii.CLASSES) if c in letters), c) for c in text]


def test_kinds_and_formats(spark):
    texts = ["mail hsr.29@mail5.example.com now", "call +1 (988) 555-2485.", "card 4111111111111111 or 4111-1111-1111-1112", "at 42.144.35.254, 1.2.3", "ssn 123-45-6789", "pay DE89370400440532013000",
             "Mr. John Smith met Frau Müller", "Госпожа Иванова тут", None, "", "no data 12 34", "é𝒳 a@b.co"]
    out, found = run(spark, texts)
    kinds = [[pii.KINDS[e[2]] for e in f] for f in found]
    assert kinds == [["email"], ["phone"], ["card", "card"], ["ip"], ["ssn"], ["iban"], ["name", "name"], ["name"], [], [], [], ["email"]]
    for text, new, es in zip(texts, out, found, strict=True):
        for start, end, kind, value, made in es:
            assert text[start:end] == value and value not in new and made in new
            if pii.KINDS[kind] != "ip":
                assert shape(made) == shape(value)
        if not es:
            assert new == text
    a, b = (e[4] for e in found[2])
    assert luhn(a) and not luhn(b) and a[0] == b[0] == "4"
    assert all(0 <= int(o) <= 255 for o in found[3][0][4].split("."))
    assert found[1][0][4].startswith("+1 (") and found[5][0][4].startswith("DE")
    assert [e[4].split()[0] for e in found[6]] == ["Mr.", "Frau"] and found[6][0][4][-1] == "h"


def test_distinct_and_coreferent(spark):
    rng = random.Random(1)
    values = [f"{a}{b}@x.co" for a in "abcde" for b in "0123456789"] + [f"10.0.{i}.{j}" for i in range(12) for j in range(12)] + [f"+1 (555) 555-{rng.randrange(10**4):04d}" for _ in range(150)]
    out, found = run(spark, [f"x {v} y" for v in values + values] + ["AB@X.co ab@x.co"])
    made = {}
    for es in found[:-1]:
        ((_, _, kind, value, surrogate),) = es
        assert made.setdefault((kind, value), surrogate) == surrogate and surrogate != value
    assert len(set(made.values())) == len(made)
    first, second = (e[4] for e in found[-1])
    assert first.lower() == second and first != second
    other, _ = run(spark, [f"x {v} y" for v in values], key="other")
    assert sum(a == b for a, b in zip(out, other, strict=False)) < 20
    df = spark.createDataFrame([(0, " ".join(values))], SCHEMA)
    assert pii.collisions(pii.pseudonymize(df, "k")).collect() == []
    assert pii.pseudonymize(df.limit(0), "k").collect() == []


def test_short_names_exhaustively(spark):
    consonants, vowels = "BCDFGHJKLMNPQRSTVWXYZ", "aeiou"
    names = [f"Mr. {c}{v}{last}" for c in consonants for v in vowels for last in "en"] + [f"Frau {c}o" for c in consonants] + [f"Mr. {a}o {b}i" for a in consonants for b in consonants]
    for key in ("k", "boxloom surrogate key"):
        _, found = run(spark, names, key)
        made = [e[0][4] for e in found]
        assert all(a != b for a, b in zip(made, names, strict=True)) and len(set(made)) == len(names)


def test_one_entity_in_several_forms(spark):
    _, found = run(spark, ["+1 555-123-4567 and (555) 123-4567 and 555.123.4567", "Mr. John Smith, Mr Smith", "10.0.0.1"])
    digits = [re.sub("[^0-9]", "", e[4])[-10:] for e in found[0]]
    assert len(digits) == 3 and len(set(digits)) == 1 and digits[0] != "5551234567"
    assert found[0][0][4].startswith("+1 ")
    assert found[1][0][4].split()[-1] == found[1][1][4].split()[-1] != "Smith"


def test_more_forms(spark):
    texts = ["Herr Öäö", "call 555 123 4567 or 555-123-4567", "DE89 3704 0044 0532 0130 00 is DE89370400440532013000", "at fe80::1:2a and 2001:0db8:0000:0000:0000:ff00:0042:8329, at 12:30:10", "4111-1111-1111-1111 is 4111 1111 1111 1111"]
    out, found = run(spark, texts)
    assert [[pii.KINDS[e[2]] for e in f] for f in found] == [["name"], ["phone"] * 2, ["iban"] * 2, ["ipv6"] * 2, ["card"] * 2]
    assert "Öäö" not in out[0] and shape(found[0][0][4]) == shape("Herr Öäö")
    bare = lambda x: re.sub("[^0-9A-Za-z]", "", x)
    for i in (1, 2, 4):
        assert bare(found[i][0][4]) == bare(found[i][1][4]) != bare(found[i][0][3])
    assert all(re.fullmatch("[0-9a-f:]+", e[4]) and [len(x) for x in e[4].split(":")] == [len(x) for x in e[3].split(":")] for e in found[3])


def test_texts_that_stop_a_backtracking_matcher(spark):
    """Runs that a matcher could only undo step by step; each took the process down, or time with the square of its length."""
    texts = ["x@" + "a." * 20_000 + " 1", "a" * 60_000 + " 1", "x@" * 20_000 + "1", "1" * 60_000, "AB12" + " AB12" * 10_000, "a:" * 30_000, "Mr. " * 20_000 + "A", "1.2." * 20_000, "mail a@b.co " * 3000]
    out, found = run(spark, texts)
    assert [len(f) for f in found[:2]] == [0, 0] and len(found[-1]) == 3000
    assert len(set(out[-1].split())) == 2 and "a@b.co" not in out[-1]


def permuted(text, key, tag):
    """The network as the module's docstring has it, in plain Python."""

    def shifted(half, stream, sign):
        out = []
        for i, c in enumerate(half):
            letters = next((k for k in pii.CLASSES if c in k), None)
            by = int(stream[i % 32 * 2 : i % 32 * 2 + 2], 16) * sign
            out.append(letters[(letters.index(c) + by) % len(letters)] if letters else c)
        return "".join(out)

    cut = len(text) // 2
    a, b = text[:cut], text[cut:]
    for n in (1, 2, 3, 0, -3, -2, -1):
        if n == 0:
            whole = list(b + a)
            for i, c in enumerate(whole):
                letters = next((k for k in pii.CLASSES if c in k), None)
                if letters:
                    whole[i] = letters[(letters.index(c) + 1) % len(letters)]
                    break
            whole = "".join(whole)
            a, b = whole[:cut], whole[cut:]
        else:
            stream = hashlib.sha256("\x1f".join((key, tag, str(abs(n)), a.lower())).encode()).hexdigest()
            a, b = shifted(b, stream, 1 if n > 0 else -1), a
    return b + a


def surrogate(kind, value, key):
    index, name = str(kind), pii.KINDS[kind]
    if name == "ip":
        o = [int(x) for x in value.split(".")]
        a, b = o[0] * 256 + o[1], o[2] * 256 + o[3]
        for n in (1, 2, 3, 0, -3, -2, -1):
            by = int(hashlib.sha256("\x1f".join((key, "ip", str(abs(n)), str(a))).encode()).hexdigest()[:4], 16)
            a, b = (b, a ^ 1) if n == 0 else (b ^ by, a)
        return ".".join(str(x) for w in (b, a) for x in (w >> 8, w & 255))
    head, tail = (regex.search(p, value)[0] for p in pii.KEPT[name])
    body = value[len(head) : len(value) - len(tail)]
    if name == "name":
        return head + " ".join(permuted(w[:-1], key, "\x1f".join((index, w[-1].lower()))) + w[-1] for w in body.split(" "))
    tag = "\x1f".join([index] + ([head.lower()] if name != "phone" else []) + ([tail.lower()] if name != "card" else []))
    if name == "ipv6":
        coded = "".join(pii._HEX["0123456789abcdef".index(c)] if c in "0123456789abcdef" else c for c in body.lower())
        return "".join("0123456789abcdef"[pii._HEX.index(c)] if c in pii._HEX else c for c in permuted(coded, key, tag))
    if name in ("card", "phone", "iban"):
        made = iter(permuted(re.sub("[^0-9A-Za-z]", "", body), key, tag))
        new = "".join(next(made) if re.match("[0-9A-Za-z]", c) else c for c in body)
    else:
        new = permuted(body, key, tag)
    if name == "card":
        digit = next(d for d in range(10) if luhn(head + body + str(d)))
        wanted = (next(d for d in range(10) if luhn(head + new + str(d))) + int(tail) - digit) % 10
        return head + new + str(wanted)
    return head + new + tail


def brute(text, key):
    met = sorted((m.start(), -m.end(), k, m[0]) for k, p in enumerate(pii.PATTERNS.values()) for m in regex.finditer(p, text or ""))
    out, spans, at = "", [], 0
    for start, end, kind, value in met:
        if start >= at:
            out += text[at:start] + surrogate(kind, value, key)
            spans.append(f"{pii.KINDS[kind]}:{start}:{-end}")
            at = -end
    return (None if text is None else out + text[at:]), ",".join(spans)


def test_query_against_brute_force(spark, tmp_path):
    from boxloom.llm import queries

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(-1, None), (-2, ""), (None, "Mr. Ångström, a.b@c-d.co.uk; Госпожа Ёлкина"), (-3, "fe80::1 DE89 3704 0044 0532 0130 00"), (-3, "fe80::1 DE89 3704 0044 0532 0130 00")]
    docs += [(-10 - i, f"u{i}@x.co, call +1 555-555-{i:04d}; 10.0.{i}.1 and Mrs. Kay Lo") for i in range(20)]
    docs += [(-100 - i, f"Herr {c}{d}x, Frau Ý{c.lower()}ş") for i, (c, d) in enumerate((c, d) for c in "ÈÉÜÝÞ" for d in "àìÿßø")]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set(queries.PII_SETTING, "of the tests")
    try:
        got = [tuple(r) for r in queries.op5_pii(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset(queries.PII_SETTING)
    want = [(i, new, spans.count(",") + 1 if spans else 0, spans) for i, t in docs for new, spans in [brute(t, "of the tests")]]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[2] for r in got) > 50


def test_collisions_are_refused(spark):
    df = spark.sql("SELECT array(named_struct('kind', 0, 'value', 'a@b.co', 'surrogate', 'x@y.co'), named_struct('kind', 0, 'value', 'c@d.co', 'surrogate', 'X@y.co')) AS entities")
    with pytest.raises(ValueError, match="stands for 2"):
        pii.checked(df)


def test_accented_names_in_either_case(spark):
    """Each of 744 names with an accented capital and an accented small letter, and the same names in capitals."""
    small = [chr(c) for c in range(0xE0, 0x100) if chr(c).isalpha() and chr(c) not in "ßÿ"]
    names = [f"{c.upper()}{d}{e}" for c in small for d in small for e in "xr"][:744]
    _, found = run(spark, [f"Herr {n}, Herr {n.upper()}" for n in names])
    made = [[e[4] for e in f] for f in found]
    assert all(len(m) == 2 and m[0].split()[1].upper() == m[1].split()[1] for m in made)
    assert len({m[0] for m in made}) == len({m[1] for m in made}) == len(names)
    df = spark.createDataFrame(list(enumerate(f"Herr {n}, Herr {n.upper()}" for n in names)), "doc_id long, text string")
    assert pii.collisions(pii.pseudonymize(df, "k")).count() == 0
    assert all(len(k) > 1 for k in pii.CLASSES) and len(set("".join(pii.CLASSES))) == sum(map(len, pii.CLASSES))
