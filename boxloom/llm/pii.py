"""Surrogates for personal data: keyed, type-consistent, distinct, the same for the same entity.

Entities are e-mail addresses, card numbers, telephone numbers, IPv4 and IPv6
addresses, account numbers (IBAN), social security numbers, and names after a
title. Each is replaced by another of its kind. The replacement is a keyed *permutation* of
all entities of one format: a Feistel network whose rounds shift one half of the
text by a hash of the other half, each character inside its own class (digits,
vowels and consonants of either case, the letters of either case of each block
of Latin, Greek, Cyrillic and Armenian); then the first such character moves on by one, and the network is undone.
So no text with such a character stays as it is, two entities never share a
surrogate, one entity has the same one everywhere, and script, case, length and
punctuation stay, without any table or join. What says the gender of a name
stays as well: its title and last letter.

The words of a name are permuted one by one, whatever its title, so that a name
with and without the first name corresponds. So do telephone numbers with and
without a country code, and telephone, card and account numbers however they are
spaced, as their digits and letters alone are permuted; a country code not set
off from the number counts to its digits. A name without a title is not found,
and a surrogate is a string of the name's make-up, not a name from a list: a
list has an end, and with it either two entities share a name or all entities
must be held in a table.

Kinds keep what makes them valid: octets stay octets (the network works on the
32-bit number), card numbers keep their first digit and whether their check
digit holds, telephone numbers their country code, addresses their last domain
label, accounts their country.

:func:`collisions` checks distinctness over a corpus, from surrogates in fact
made; :func:`checked` refuses a result that has any.

Native: JVM expressions only; nothing is shuffled.

Defined results: null texts stay null and have no entities; where two kinds
overlap, the one that begins first wins, then the longer, then the one listed
first; rows that repeat are replaced alike; an empty table gives no rows; other
columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.secrets import _spans
from boxloom.llm.text import let

_TITLES = "Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr|Господин|Госпожа"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _cased(blocks: list[tuple[int, int]]) -> list[str]:
    """The classes of each block: its small letters and, in the same order, their capitals; then the small ones, capitals and others without a counterpart.

    Either case of a letter moves alike, so that a name and the name in capitals
    correspond. A letter that would be alone in its class joins the others.
    """
    out = []
    for lo, hi in blocks:
        letters = [chr(c) for c in range(lo, hi) if chr(c).isalpha()]
        small = [c for c in letters if c.islower() and c.upper() != c and c.upper() in letters and c.upper().lower() == c]
        capital = [c.upper() for c in small]
        alone = [c for c in letters if c not in small and c not in capital]
        kinds = [[c for c in alone if c.islower()], [c for c in alone if c.isupper()]]
        kinds = [k for k in kinds if len(k) > 1]
        rest = [c for c in alone if not any(c in k for k in kinds)]
        if len(rest) == 1 and kinds:
            kinds[0] += rest
            rest = []
        out += ["".join(k) for k in (small, capital, *kinds, rest) if k]
    return out


#: Stand-ins for the sixteen hexadecimal digits while they are permuted.
_HEX = "".join(chr(0xE000 + i) for i in range(16))
#: Blocks by their code points: Latin-1, Latin Extended-A, Greek, Cyrillic, Armenian.
_BLOCKS = [(0xC0, 0x100), (0x100, 0x180), (0x386, 0x400), (0x400, 0x482), (0x531, 0x588)]
CLASSES = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", *_cased(_BLOCKS), _HEX)
_LETTERS = "".join(CLASSES[1:-1])
_UPPER = "".join(c for c in _LETTERS if c.isupper())
#: Kinds and their patterns, in order of precedence. No group repeats without bound: Java would take a stack frame a turn.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9])[A-Za-z0-9.-]*[A-Za-z0-9]\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.]){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9+])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{13,19})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9])",
    "name": rf"(?<![\p{{L}}])(?:{_TITLES})\.? [{_UPPER}][{_LETTERS}]+(?: [{_UPPER}][{_LETTERS}]+)?",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
}
#: A text without any of these has no entity.
HINT = rf"[0-9@]|(?:{_TITLES})\.? [{_UPPER}]"
KINDS = tuple(PATTERNS)


def _hash(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256)


#: All letters of the classes, and each one's next.
_EACH, _NEXT = "".join(CLASSES), "".join(k[1:] + k[0] for k in CLASSES)
#: Rounds of a network, the step between, and the rounds undone.
_STEPS = (1, 2, 3, 0, -3, -2, -1)


def _shifted(text: Column, stream: Column, sign: Column) -> Column:
    """Each character moved inside its class by two hex digits of the stream, forwards or (sign -1) back."""

    def one(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(stream, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int") * sign
        class_ = F.coalesce(*[F.when(F.instr(F.lit(letters), c) > 0, letters) for letters in CLASSES], F.lit(""))
        moved = lambda k: F.substring(k, F.pmod(F.instr(k, c) - 1 + by, F.char_length(k)) + 1, F.lit(1))
        return let(class_, lambda k: F.when((c == "") | (k == ""), c).otherwise(moved(k)))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def permuted(text: Column, key: Column, tag: Column) -> Column:
    """The keyed permutation of texts of one format; ``tag`` picks the permutation and must itself be kept."""
    def halves(whole: Column) -> Column:
        half = F.floor(F.char_length(whole) / 2).cast("int")
        return F.struct(F.substring(whole, F.lit(1), half).alias("a"), F.substring(whole, half + 1, F.char_length(whole)).alias("b"))

    # what is moved keeps no place when moved between a network and its inverse: the result is a permutation as the step is, without fixed points
    def between(whole: Column) -> Column:
        part = lambda i: F.regexp_extract(whole, f"(?s)^([^{_EACH}]*)(.?)(.*)$", i)
        return halves(F.concat(part(1), F.translate(part(2), _EACH, _NEXT), part(3)))

    # a round moves the second half by a hash of the first and swaps the two; after three they are swapped once too often
    def step(s: Column, n: Column) -> Column:
        moved = let(_hash(key, tag, F.abs(n).cast("string"), F.lower(s["a"])), lambda stream: _shifted(s["b"], stream, F.signum(n).cast("int")))
        return F.when(n == 0, let(F.concat(s["b"], s["a"]), between)).otherwise(F.struct(moved.alias("a"), s["a"].alias("b")))

    return F.aggregate(F.array(*[F.lit(n) for n in _STEPS]), halves(text), step, lambda s: F.concat(s["b"], s["a"]))


def _ip(v: Column, key: Column) -> Column:
    part = lambda p, i: F.get(p, F.lit(i)).cast("int")
    show = lambda x: F.concat_ws(".", F.shiftright(x, 8).cast("string"), x.bitwiseAND(F.lit(255)).cast("string"))

    def step(s: Column, n: Column) -> Column:
        by = F.conv(F.substring(_hash(key, "ip", F.abs(n).cast("string"), s["a"].cast("string")), 1, 4), 16, 10).cast("int")
        between = F.struct(s["b"].alias("a"), s["a"].bitwiseXOR(F.lit(1)).alias("b"))
        return F.when(n == 0, between).otherwise(F.struct(s["b"].bitwiseXOR(by).alias("a"), s["a"].alias("b")))

    sides = let(F.split(v, r"\."), lambda p: F.struct((part(p, 0) * 256 + part(p, 1)).alias("a"), (part(p, 2) * 256 + part(p, 3)).alias("b")))
    return F.aggregate(F.array(*[F.lit(n) for n in _STEPS]), sides, step, lambda s: F.concat_ws(".", show(s["b"]), show(s["a"])))


def check_digit(body: Column) -> Column:
    """The Luhn digit that completes a number."""
    digits = F.reverse(F.split(F.regexp_replace(body, "[^0-9]", ""), ""))
    doubled = F.transform(digits, lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda s, x: s + x), F.lit(10))


#: What a kind keeps before and after the part that is permuted. What is kept also picks the permutation, but for telephone numbers and names.
KEPT = {
    "email": ("^", r"\.[A-Za-z]+$"), "iban": ("^[A-Z]{2}", "$"), "card": ("^[0-9]", "[0-9]$"), "ssn": ("^", "$"),
    "phone": (r"^(?:\+[0-9]{1,3}(?=[ .(-]))?", "$"), "name": (r"^\p{L}+\.? ", "$"), "ipv6": ("^", "$"),
}


def _made(kind: Column, v: Column, key: Column) -> Column:
    def by_kind(side: int) -> Column:
        out = F.lit("")
        for k, kept in KEPT.items():
            out = F.when(kind == KINDS.index(k), F.regexp_extract(v, kept[side], 0)).otherwise(out)
        return out

    def whole(h: Column) -> Column:
        head, tail = h["head"], h["tail"]
        body = F.substring(v, F.char_length(head) + 1, F.char_length(v) - F.char_length(head) - F.char_length(tail))
        card, phone, name, ipv6 = (kind == KINDS.index(k) for k in ("card", "phone", "name", "ipv6"))
        spacing = kind.isin(*[KINDS.index(k) for k in ("card", "phone", "iban")])
        tag = F.concat_ws("\x1f", kind.cast("string"), F.when(~phone, F.lower(head)), F.when(~card, F.lower(tail)))
        one = lambda text, tag: F.struct(text.alias("text"), tag.alias("tag"), F.lit("").alias("last"))

        def of_name(w: Column) -> Column:
            last = F.substring(w, -1, 1)
            return F.struct(F.substring(w, F.lit(1), F.char_length(w) - 1).alias("text"), F.concat_ws("\x1f", kind.cast("string"), F.lower(last)).alias("tag"), last.alias("last"))

        hexed = F.translate(F.lower(body), "0123456789abcdef", _HEX)
        parts = F.when(name, F.transform(F.split(body, " "), of_name)).otherwise(F.array(one(F.when(spacing, F.regexp_replace(body, "[^0-9A-Za-z]", "")).when(ipv6, hexed).otherwise(body), tag)))
        made = F.array_join(F.transform(parts, lambda p: F.concat(permuted(p["text"], key, p["tag"]), p["last"])), " ")

        def spaced(digits: Column) -> Column:
            begin = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

            def step(acc: Column, c: Column) -> Column:
                digit = c.rlike("[0-9A-Za-z]")
                return F.struct((acc["at"] + digit.cast("int")).alias("at"), F.concat(acc["out"], F.when(digit, F.substring(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"))

            return F.aggregate(F.split(body, ""), begin, step, lambda acc: acc["out"])

        def ended(new: Column) -> Column:
            digit = F.pmod(check_digit(F.concat(head, new)) + tail.try_cast("int") - check_digit(F.concat(head, body)), F.lit(10))
            return F.concat(head, new, F.when(card, digit.cast("string")).otherwise(tail))

        return let(let(made, lambda new: F.when(spacing, spaced(new)).when(ipv6, F.translate(new, _HEX, "0123456789abcdef")).otherwise(new)), ended)

    return F.when(kind == KINDS.index("ip"), _ip(v, key)).otherwise(let(F.struct(by_kind(0).alias("head"), by_kind(1).alias("tail")), whole))


def entities(text: Column) -> Column:
    """Array of (start, end, kind, value): the entities of a text, none overlapping; kind is a place in ``KINDS``."""
    found = F.concat(*[_spans(text, p, i) for i, p in enumerate(PATTERNS.values())])
    keyed = F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("far"), s["kind"].alias("kind"), s["value"].alias("value")))
    shape = "array<struct<start:bigint,end:bigint,kind:int,value:string>>"
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(shape).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        one = F.struct(s["start"].alias("start"), (-s["far"]).alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))
        free = s["start"] >= acc["at"]
        return F.struct(F.when(free, -s["far"]).otherwise(acc["at"]).alias("at"), F.when(free, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(HINT), F.aggregate(F.array_sort(keyed), begin, step)["out"]).otherwise(F.array().cast(shape))


def with_surrogates(found: Column, key: str) -> Column:
    """The entities with their surrogates: array of (start, end, kind, value, surrogate)."""

    def one(s: Column) -> Column:
        made = _made(s["kind"], s["value"], F.lit(key))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"), made.alias("surrogate"))

    return F.transform(found, one)


def replaced(text: Column, found: Column) -> Column:
    """The text with its entities replaced."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, s["surrogate"]).alias("out"))

    whole = F.aggregate(found, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))
    return F.when(F.size(found) == 0, text).otherwise(whole)


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "entities") -> DataFrame:
    """``docs`` with the text replaced, and ``found_col``: the entities with their surrogates."""
    columns = [c for c in docs.columns if c != found_col]
    plain = docs.select(*columns).toDF(*[f"c{i}" for i in range(len(columns))])
    text = f"c{columns.index(text_col)}"
    listed = plain.select("*", entities(F.coalesce(F.col(text), F.lit(""))).alias("_e"))
    made = listed.select(*plain.columns, F.when(F.size("_e") > 0, with_surrogates(F.col("_e"), key)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,kind:int,value:string,surrogate:string>>")).alias("_e"))
    return made.withColumn(text, replaced(F.col(text), F.col("_e"))).toDF(*columns, found_col)


def collisions(found: DataFrame, found_col: str = "entities") -> DataFrame:
    """Surrogates that stand for more than one entity: kind, surrogate and entities. E-mail and IPv6 addresses are the same in either case."""
    each = found.select(F.explode(found_col).alias("e"))
    folded = F.col("e.kind").isin(KINDS.index("email"), KINDS.index("ipv6"))
    shown = {side: F.when(folded, F.lower(f"e.{side}")).otherwise(F.col(f"e.{side}")).alias(side) for side in ("surrogate", "value")}
    return each.select(F.col("e.kind").alias("kind"), *shown.values()).distinct().groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checked(found: DataFrame, found_col: str = "entities") -> DataFrame:
    """``found`` (a written table), if no surrogate in it stands for two entities; else ValueError.

    Only entities are read, once, and only one row comes to the driver.
    """
    worst = collisions(found, found_col).first()
    if worst is not None:
        raise ValueError(f"a surrogate of kind {KINDS[worst['kind']]} stands for {worst['n']} entities")
    return found
