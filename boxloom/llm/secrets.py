"""Secret scans: known shapes, and a battery of randomness tests for the rest.

*Base kinds* are found by their patterns. *Random* spans are found among tokens
(runs of ``TOKEN`` characters) by tests that depend on the encoding inferred
for the token (hexadecimal, base 32, base 36 or base 64 by its characters):

* chi-squared uniformity of its symbols over the encoding's alphabet,
* Wald-Wolfowitz runs of symbols above and below the alphabet's middle,
* lag-1 serial correlation of the symbols' numbers.

A token stays a candidate if the three together (Bonferroni, two-sided for the
last two) do not refute uniform randomness at ``REFUTE``. Random looks are weak
evidence for a short token, so the other error is controlled as well, from the
same symbols: the likelihood of an ordinary word or name (letters at their
frequencies in text; neighbours change their class, digit, lower, upper or sign,
at a rate of ``SWITCH``) against that of the encoding's uniform symbols. Under
the null such a ratio is under t with a probability of t at most (Markov), so
that it is itself a p-value. The
Benjamini-Hochberg procedure keeps the share of false finds at ``FDR`` within
each length class (powers of two): one pass over the texts fills a histogram of
p-values by class, whose size does not depend on the data, and the thresholds
follow from it.

Native: JVM expressions only, and nothing is shuffled but the histogram.

Defined results: null counts as the empty text and has no spans; places count
code points; rows that repeat are scanned each; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.text import let
from boxloom.runtime import write_table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i:password|passwd|secret|token|api_?key)"
#: Matches that end up too short never hide one that is long enough: the run's own end ends both.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
KINDS = ("assign", "access", "hex", "random")

REFUTE, SWITCH, FDR = 0.001, 0.15, 0.01
#: p-values are kept as whole numbers of -10 log10 p up to this.
STEPS = 400
CLASSES = 32
#: Letters a to z in text, per mille over several languages; a share of ``EVEN`` is spread evenly for those not thought of.
LETTERS = (90, 16, 33, 46, 148, 15, 17, 27, 72, 4, 6, 47, 29, 76, 60, 24, 8, 67, 71, 68, 47, 13, 12, 3, 8, 8)
EVEN = 0.2
#: Alphabets that the encoding is chosen from: hex and base 36 in either case, base 32, base 64 with either signs.
CHOICES = 7

ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def _spans(text: Column, pattern: str, kind: str | int, hint: str | None = None, group: int | None = None, least: int = 0) -> Column:
    """Array of (start, end, order, kind, value) of a pattern's matches; those whose ``group`` is under ``least`` are dropped."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    both = F.zip_with(found, values, lambda m, v: F.struct(m.alias("m"), v.alias("v")))
    rows = F.zip_with(F.slice(between, 1, F.size(found)), both, lambda b, x: F.struct(F.char_length(b).alias("gap"), x["m"].alias("m"), x["v"].alias("v")))
    order = kind if isinstance(kind, int) else KINDS.index(kind)
    kind_of = "array<struct<start:bigint,end:bigint,kind:int,value:string>>"
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind_of).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(order).alias("kind"), x["m"].alias("value"))
        kept = acc["out"] if not least else F.when(F.char_length(x["v"]) >= least, F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.struct(end.alias("at"), (kept if least else F.array_append(acc["out"], span)).alias("out"))

    listed = F.aggregate(rows, begin, step)["out"]
    return F.when(text.rlike(hint or pattern), listed).otherwise(F.array().cast(kind_of))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds by start, then kind."""
    return F.array_sort(F.concat(_spans(text, ASSIGN, "assign", ASSIGN_HINT, 2, 8), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")))


def _normal_tail(z: Column) -> Column:
    """P(|Z| > |z|) of the standard normal, to about 1e-7 (Abramowitz and Stegun 7.1.26)."""
    return let(F.abs(z) / F.lit(math.sqrt(2)), _erfc)


def _erfc(x: Column) -> Column:
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def encoding(token: Column) -> Column:
    """The smallest alphabet that has all of a token's characters; padding and the URL-safe signs count as base 64."""
    return (
        F.when(token.rlike("^[0-9a-f]+$") | token.rlike("^[0-9A-F]+$"), "hex")
        .when(token.rlike("^[A-Z2-7]+=*$"), "base32")
        .when(token.rlike("^[0-9a-z]+$") | token.rlike("^[0-9A-Z]+$"), "base36")
        .otherwise("base64")
    )


def _symbols(token: Column, name: Column) -> Column:
    plain = F.regexp_replace(F.translate(token, "-_", "+/"), "=+$", "")
    plain = F.when(name.isin("hex", "base36"), F.lower(plain)).otherwise(plain)
    table = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])
    return let(table[name], lambda letters: F.transform(F.split(plain, ""), lambda c: F.instr(letters, c) - 1))


def _classes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3))


def _changes(values: Column) -> Column:
    """How often neighbours differ."""
    n = F.size(values)
    return F.aggregate(F.zip_with(F.slice(values, 1, n - 1), F.slice(values, 2, n - 1), lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def looks_random(symbols: Column, size: Column) -> Column:
    """Whether the battery leaves uniform randomness standing. ``symbols``: numbers below ``size``; 20 or more of them."""
    return let(symbols, lambda x: _battery(x, size.cast("double")))


def _battery(symbols: Column, a: Column) -> Column:
    n = F.size(symbols).cast("double")
    squares = _sum(F.transform(F.array_distinct(symbols), lambda s: F.pow(F.size(F.filter(symbols, lambda x: x == s)).cast("double"), F.lit(2.0))))
    chi, df = a / n * squares - n, a - 1
    # Wilson-Hilferty: the cube root of chi-squared over df is nearly normal
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    p_chi = let(z_chi, lambda z: F.when(z > 0, _normal_tail(z) / 2).otherwise(1.0))
    p_runs = let(F.transform(symbols, lambda s: (s >= a / 2).cast("int")), lambda high: _runs(high, n))
    average = _sum(F.transform(symbols, lambda s: s.cast("double"))) / n
    off = let(average, lambda m: F.transform(symbols, lambda s: s - m))
    return F.least(p_chi, p_runs, let(off, lambda x: _serial(x, n))) * 3 >= REFUTE


def _runs(high: Column, n: Column) -> Column:
    n1 = _sum(F.transform(high, lambda h: h.cast("double")))

    def judged(n1: Column) -> Column:
        mean = 2 * n1 * (n - n1) / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        return F.when(spread > 0, _normal_tail((_changes(high) + 1 - mean) / F.sqrt(F.greatest(spread, F.lit(1e-12))))).otherwise(0.0)

    return let(n1, judged)


def _serial(off: Column, n: Column) -> Column:
    k = F.size(off)
    lagged = _sum(F.zip_with(F.slice(off, 1, k - 1), F.slice(off, 2, k - 1), lambda x, y: x * y))
    power = _sum(F.transform(off, lambda x: x * x))
    return let(power, lambda p: F.when(p > 0, _normal_tail(lagged / F.greatest(p, F.lit(1e-12)) * F.sqrt(n))).otherwise(0.0))


def _decibans(share: float) -> float:
    return -10 * math.log10(share)


def evidence(token: Column, size: Column) -> Column:
    """-10 log10 of the p-value of an ordinary word, rounded down, 0 to ``STEPS``. ``size``: of the encoding's alphabet."""
    letters = [_decibans(EVEN / 26 + (1 - EVEN) * n / sum(LETTERS)) for n in LETTERS]
    cost = F.array(*[F.lit(x) for x in [_decibans(1 / 4), *letters, *[_decibans(1 / 10)] * 10]])
    known = F.lit("abcdefghijklmnopqrstuvwxyz0123456789")

    def judged(plain: Column) -> Column:
        n = F.char_length(plain).cast("double")
        symbols = _sum(F.transform(F.split(F.lower(plain), ""), lambda c: F.get(cost, F.instr(known, c))))
        changes = let(_classes(plain), _changes)
        text = symbols + _decibans(1 / 4) + changes * _decibans(SWITCH / 3) + (n - 1 - changes) * _decibans(1 - SWITCH)
        uniform = n * F.log10(size.cast("double")) * 10 + 10 * math.log10(CHOICES)
        return F.greatest(F.lit(0), F.least(F.floor(text - uniform), F.lit(STEPS))).cast("int")

    return let(F.regexp_replace(token, "=+$", ""), judged)


def candidates(text: Column, base: Column) -> Column:
    """Array of (start, end, class, score): tokens outside base spans; score 0 where randomness is refuted."""
    tokens = F.filter(_spans(text, TOKEN, "random"), lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))

    def judged(t: Column) -> Column:
        value = t["value"]
        name = encoding(value)
        size = F.when(name == "hex", 16).when(name == "base32", 32).when(name == "base36", 36).otherwise(64)
        kept = let(evidence(value, size), lambda score: F.when(value.rlike(UUID), 0).when((score > 0) & looks_random(_symbols(value, name), size), score).otherwise(0))
        level = F.floor(F.log2(F.char_length(value).cast("double"))).cast("int")
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), level.alias("level"), kept.alias("score"))

    return F.transform(tokens, judged)


def thresholds(histogram: list[tuple[int, int, int]], fdr: float = FDR) -> dict[int, int]:
    """Benjamini-Hochberg by length class. ``histogram``: rows (class, score, tokens). The least score to report in each class."""
    out = {}
    for level in {h[0] for h in histogram}:
        rows = sorted(((s, n) for lv, s, n in histogram if lv == level), reverse=True)
        total, seen = sum(n for _, n in rows), 0
        for score, n in rows:
            seen += n
            if score > 0 and total * 10 ** (-score / 10) <= fdr * seen:
                out[level] = score
    return out


def fit(docs: DataFrame, cands: str = "cands", fdr: float = FDR) -> dict[int, int]:
    """Thresholds from a table with a column of candidates; the histogram has ``CLASSES * STEPS`` rows at most."""
    rows = docs.select(F.explode(cands).alias("c")).groupBy("c.level", "c.score").agg(F.count(F.lit(1)).alias("n")).collect()
    return thresholds([(r["level"], r["score"], r["n"]) for r in rows], fdr)


def found_random(cands: Column, limits: dict[int, int]) -> Column:
    """Random spans among candidates."""
    if not limits:
        return F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")
    table = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    kept = F.filter(cands, lambda c: F.coalesce(c["score"] >= F.try_element_at(table, c["level"]), F.lit(False)))
    return F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(3).alias("kind")))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def _by_start(spans: Column) -> Column:
    """By start, then kind."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(keyed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def told(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _scanned(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    based = docs.select(*keep, text.alias("_text"), base_spans(text).alias("_base"))
    return based.select(*keep, "_text", _by_start(_bare(F.col("_base"))).alias("base"), F.when(F.col("_text").rlike(TOKEN), candidates(F.col("_text"), F.col("_base"))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,level:int,score:int>>")).alias("cands"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """doc_id, base and spans (all, base ones included): arrays of (start, end, kind number in ``KINDS``)."""
    seen = write_table(_scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_in")), ["doc_id"], "_in").drop("_text"), "spans")
    limits = fit(seen, fdr=fdr)
    return seen.select("doc_id", "base", _by_start(F.concat("base", found_random(F.col("cands"), limits))).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mask``; null texts stay null. The texts are read twice and not shuffled."""
    columns = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*columns)
    text = columns[docs.columns.index(text_col)]
    limits = fit(_scanned(plain.select(text), [], text).select("cands"), fdr=fdr)
    seen = _scanned(plain, columns, text)
    spans = _by_start(F.concat("base", found_random(F.col("cands"), limits)))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        # a span that begins inside the one before only lengthens it
        gap = F.substring(F.col("_text"), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(F.col("_spans"), begin, step)
    clean = F.concat(done["out"], F.substring(F.col("_text"), (done["at"] + 1).cast("int"), F.char_length("_text")))
    masked = seen.select(*columns, "_text", spans.alias("_spans")).withColumn(text, F.when(F.col(text).isNull() | (F.size("_spans") == 0), F.col(text)).otherwise(clean))
    return masked.select(*columns).toDF(*docs.columns)
