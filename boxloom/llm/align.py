"""Alignment of two tokenizers' tokens over the bytes of each text.

Side A is a byte-level BPE file, side B a piece model that puts a space before
the text; A reads the text with that space. Bitsets, packed 64 bytes of text a
word, mark the last byte of every token of either side. Their AND has the shared
cuts, which end the *groups*; popcounts summed word by word (rank) turn a cut's
byte into the number of tokens that end there, and so into token ranges; the set
bits of their OR (select) are the *links*: between two neighbouring ends of
either side lies one token of A and one of B, and every two tokens that overlap
have one such stretch.

Counting: a pair of ids counts once a document. Texts are worked on in blocks of
about ``SLICE`` bytes; a block lists its distinct pairs once, in how many of its
documents each is, and documents name pairs by their place in that list. Only
the lists meet the counts of the corpus, by pair; what they found goes back to
the block's documents. A pair that is in every document is one row a block there.

Defined results: a text that is null or empty, or whose tokens' bytes do not
give it back on both sides, has no tokens: zeros and an empty alignment; strings
of special tokens are plain text; a null doc_id stays null and rows that repeat
are documents each; an empty table gives no rows; other columns are not read. A
document is worked on whole, in one task.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.text import slices
from boxloom.llm.tokens import STORE, WHITE, UnitEncoder, _byte_letters
from boxloom.runtime import write_table

#: The character that stands for a space in piece models.
BLANK = "▁"
ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pair array<int>, times array<int>, keys array<long>, held array<int>"
COUNTED = "n_best long, count_sum long"

_sides: dict[tuple[str, str], tuple[PlainEncoder, PieceEncoder]] = {}


class TokenBytes:
    """The bytes of each id, their number, and the id's decimal digits."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        shown = [str(i).encode() for i in range(len(tokens))]
        self.width = np.fromiter(map(len, shown), np.int64, len(shown))
        self.digits = np.zeros((len(tokens), int(self.width.max(initial=1)) + 1), np.uint8)
        for i, d in enumerate(shown):
            self.digits[i, : len(d)] = np.frombuffer(d, np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()])


class PlainEncoder(UnitEncoder):
    """Side A: added tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        if self.apart:
            self.apart = f" [{WHITE}]|[{WHITE}] "
        byte = {c: i for i, c in enumerate(_byte_letters())}
        tokens = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.table = TokenBytes(tokens)


class PieceEncoder:
    """Side B. No piece of the model may have a space after another character if texts are to be cut there; else they stay whole."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.cuts = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces)
        self.space = self.model.piece_to_id(BLANK)
        self.table = TokenBytes([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)])
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat, self.starts = array("I"), array("q", [0])

    def _learn(self, units: list[str]) -> None:
        for unit, ids in zip(units, self.model.encode([u[1:] for u in units], num_threads=1), strict=True):
            self.flat.extend(ids if len(unit) > 1 else [self.space])
            self.slots[unit] = len(self.slots)
            self.starts.append(len(self.flat))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, which begin with the space that the model would add, and the place of each text's first id (and the end)."""
        begins = np.zeros(len(data), bool)
        begins[offsets[:-1]] = True
        if self.cuts:
            blank = data == 0x20
            begins[1:] |= blank[1:] & ~blank[:-1]
        at = np.flatnonzero(begins)
        coded = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)).dictionary_encode()
        known = coded.dictionary.to_pylist()
        if len(self.slots) + len(known) > STORE:
            self._forget()
        self._learn([u for u in known if u not in self.slots])
        slot = np.fromiter(map(self.slots.__getitem__, known), np.int64, len(known))[coded.indices.to_numpy(zero_copy_only=False)]
        starts, flat = np.array(self.starts, np.int64), np.array(self.flat, np.uint32)
        first, sizes = starts[slot], starts[slot + 1] - starts[slot]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.r_[0, ends][np.searchsorted(at, offsets)]


class BitSet:
    """Packed bits with the number of set bits before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> BitSet:
        marks = np.zeros(-(-size // 64) * 64, bool)
        marks[places] = True
        return cls(np.packbits(marks, bitorder="little").view("<u8"))

    def __and__(self, other: BitSet) -> BitSet:
        return BitSet(self.words & other.words)

    def __or__(self, other: BitSet) -> BitSet:
        return BitSet(self.words | other.words)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Set bits before each place; places lie within the words or at their end."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        held = np.append(self.words, np.uint64(0))[word]
        return self.before[word] + np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def _sides_of(a: str, b: str) -> tuple[PlainEncoder, PieceEncoder]:
    if (a, b) not in _sides:
        _sides[a, b] = PlainEncoder(a), PieceEncoder(b)
    return _sides[a, b]


def _take(values: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the documents to keep (``at``: where each document's begin), and where theirs begin."""
    sizes = np.diff(at)
    return values[np.repeat(keep, sizes)], np.r_[0, np.cumsum(sizes[keep])]


def _both(texts: pa.Array, a: PlainEncoder, b: PieceEncoder):
    """For the texts that both sides give back: which they are, their bytes' places, and ids and their places on each side."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    spaced = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
    offsets = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    data = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    keep = np.diff(offsets) > 0
    data, at = _take(data, offsets - offsets[0], keep)
    ids_a, at_a = a.encode(spaced.filter(pa.array(keep)))
    ids_b, at_b = b.encode(data, at)
    sides = [(ids_a.astype(np.int64), at_a, a.table), (ids_b.astype(np.int64), at_b, b.table)]
    whole = data.tobytes()
    good = np.ones(len(at) - 1, bool)
    for ids, place, table in sides:
        said = table.joined(ids)
        ends = np.r_[0, np.cumsum(table.sizes[ids])][place]
        if said != whole or not np.array_equal(ends, at):
            good &= np.fromiter((said[ends[i] : ends[i + 1]] == whole[at[i] : at[i + 1]] for i in range(len(good))), bool, len(good))
    keep[keep] = good
    return keep, _take(data, at, good)[1], [(*_take(ids, place, good), table) for ids, place, table in sides]


def _written(sides, cut_a: np.ndarray, cut_b: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` of all documents as bytes, and the end of each token's there. ``cut_*``: tokens up to each group's end; ``last``: whether a group ends its document."""
    groups = np.arange(len(last))
    in_a, in_b = np.diff(np.r_[0, cut_a]), np.diff(np.r_[0, cut_b])
    places = (
        np.arange(int(in_a.sum())) + np.repeat(np.r_[0, cut_b][groups], in_a),
        np.arange(int(in_b.sum())) + np.repeat(cut_a, in_b),
    )
    n = sum(map(len, places))
    wide = max(table.digits.shape[1] for _, _, table in sides)
    chars, width = np.zeros((n, wide), np.uint8), np.empty(n, np.int64)
    mark = np.full(n, ord(","), np.uint8)
    for (ids, _, table), place in zip(sides, places, strict=True):
        chars[place, : table.digits.shape[1]] = table.digits[ids]
        width[place] = table.width[ids]
    mark[places[0][cut_a - 1]] = ord("|")
    ended = places[1][cut_b - 1]
    mark[ended] = ord(";")
    chars[np.arange(n), width] = mark
    width += 1
    width[ended[last]] -= 1
    return chars[np.arange(wide) < width[:, None]], np.r_[0, np.cumsum(width)]


def _block(batch: pa.RecordBatch, block: int, a: PlainEncoder, b: PieceEncoder) -> pa.RecordBatch:
    keep, at, sides = _both(batch.column(1), a, b)
    (ids_a, at_a, _), (ids_b, at_b, _) = sides
    size = int(at[-1])
    ends = [BitSet.of(np.cumsum(table.sizes[ids]) - 1, size) for ids, _, table in sides]
    shared, either = ends[0] & ends[1], ends[0] | ends[1]
    cuts, spots = shared.select(), either.select()
    cut_a, cut_b = (e.rank(cuts) + 1 for e in ends)
    per_doc = {"n_a": np.diff(at_a), "n_b": np.diff(at_b), "n_groups": np.diff(shared.rank(at)), "n_links": np.diff(either.rank(at))}
    last = np.zeros(len(cuts), bool)
    last[shared.rank(at[1:]) - 1] = True
    chars, char_at = _written(sides, cut_a, cut_b, last)
    chars_at = char_at[at_a + at_b]
    key = ids_a[ends[0].rank(spots)] * len(b.table.tokens) + ids_b[ends[1].rank(spots)]
    pairs_of = len(a.table.tokens) * len(b.table.tokens)
    found, times = np.unique(np.repeat(np.arange(len(at) - 1), per_doc["n_links"]) * pairs_of + key, return_counts=True)
    keys, pair, held = np.unique(found % pairs_of, return_inverse=True, return_counts=True)
    pair_at = np.searchsorted(found, np.arange(len(at)) * pairs_of)

    def every(values: np.ndarray) -> np.ndarray:
        """Values of the kept documents' ends, told for all documents."""
        return values[np.r_[0, np.cumsum(keep)]]

    def counts(values: np.ndarray) -> pa.Array:
        out = np.zeros(len(keep), np.int64)
        out[keep] = values
        return pa.array(out)

    def lists(values: np.ndarray, ends_at: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pa.array(values, kind))

    def once(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        """A list for the first row only."""
        return pa.concat_arrays([lists(values, np.array([0, len(values)]), kind), pa.nulls(len(keep) - 1, pa.list_(kind))])

    text = pa.LargeStringArray.from_buffers(len(keep), pa.py_buffer(every(chars_at)), pa.py_buffer(chars))
    columns = {
        "block": pa.array(np.full(len(keep), block)),
        "doc_id": batch.column(0),
        **{name: counts(values) for name, values in per_doc.items()},
        "groups": text.cast(pa.string()),
        "pair": lists(pair, every(pair_at), pa.int32()),
        "times": lists(times, every(pair_at), pa.int32()),
        "keys": once(keys, pa.int64()),
        "held": once(held, pa.int32()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def aligned(docs: DataFrame, byte_bpe: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's counts of tokens, groups and links, its alignment ``groups`` (``a1,a2|b1;a3|b2,b3``: ids of A, then B, a group), and its pairs by block for :func:`with_counts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _sides_of(byte_bpe, pieces)
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            yield _block(batch, block, a, b)
            block += 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ALIGNED)


def token_groups(found: DataFrame) -> DataFrame:
    """doc_id, place, a and b (arrays of ids) of every group of :func:`aligned` documents."""
    group = F.posexplode(F.split("groups", ";")).alias("place", "_group")
    side = {name: F.split(F.split_part("_group", F.lit("|"), F.lit(i)), ",").cast("array<int>").alias(name) for i, name in ((1, "a"), (2, "b"))}
    return found.where("n_groups > 0").select("doc_id", group).select("doc_id", "place", *side.values())


def pair_counts(found: DataFrame, n_b: int) -> DataFrame:
    """key, n and top of every pair: how many documents have it linked, and the most that any pair of its A id has. A pair's key is a * ``n_b`` + b."""
    listed = found.where(F.col("keys").isNotNull()).select(F.inline(F.arrays_zip("keys", "held")))
    counted = listed.groupBy(F.col("keys").alias("key")).agg(F.sum("held").alias("n"))
    by_a = Window.partitionBy(F.expr(f"key div {n_b}"))
    return counted.withColumn("top", F.max("n").over(by_a))


def _totals(key: tuple, docs: pa.Table, seen: pa.Table) -> pa.Table:
    n, top = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
    place = seen["place"].to_numpy()
    n[place], top[place] = seen["n"].to_numpy(), seen["top"].to_numpy()
    pairs, times = (docs[c].combine_chunks() for c in ("pair", "times"))
    at = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
    pair, weight = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    best, total = (np.r_[0, np.cumsum(x)] for x in (weight * (n[pair] == top[pair]), weight * n[pair]))
    out = docs.drop_columns(["block", "pair", "times"])
    return out.append_column("n_best", pa.array(np.diff(best[at]))).append_column("count_sum", pa.array(np.diff(total[at])))


def with_counts(found: DataFrame, n_b: int) -> DataFrame:
    """:func:`aligned` documents (less columns they do not need) with n_best, the links whose count is their A id's highest, and count_sum, the counts summed over links. ``n_b``: ids of side B."""
    kept = write_table(found, "aligned")
    seen = kept.where(F.col("keys").isNotNull()).select("block", F.posexplode("keys").alias("place", "key")).join(pair_counts(kept, n_b), "key").drop("key")
    docs = found.sparkSession.read.schema(kept.schema).parquet(kept.table_path).drop("keys", "held")
    plain = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("block", "pair", "times")]
    return docs.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(_totals, ", ".join([*plain, COUNTED]))


def piece_ids(pieces: str) -> int:
    """How many ids a piece model has."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces).vocab_size()
