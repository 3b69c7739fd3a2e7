"""SimHash near-duplicates over a Gray-order hierarchical index.

1. *Fingerprints*. :func:`fingerprints` takes the majority of the shingles' hash
   bits in JVM expressions alone: 32 sums, each of which counts two bits in the
   two halves of a long (a text has under 2**31 shingles, so no half overflows).
   :func:`copy_words` weighs the shingles, for the copy search below.
2. *Orders*: the different fingerprints are sorted by Gray rank in several
   orders of their bits. Two within the radius share the leading bits of one
   order at least (:func:`orders`), so that what can meet stands together, in a
   task of its own, and none is sent to places it can only miss. A row is copied
   once an order, whatever the table's size.
3. *Index*: among those that share the leading bits, 16 neighbours in Gray order
   form a node that knows the bits shared by all of them, 16 nodes one of the
   next level. A search leaves a node with all below it once the differences in
   the node's shared bits exceed the radius.
4. Links leave a task as a spanning forest, never as all pairs; components come
   from :func:`boxloom.operators.graph.connected_components`.

The search is exact at every size of the table: no candidate is capped, and
no threshold follows the count. Fingerprints are different from each other, so a
task holds no copies, and one has no more neighbours than the ball of its radius.

:func:`near_copies` joins texts whose shingle sets have a Jaccard similarity of
0.8. At that similarity plain SimHash words differ in 15 % of their bits, which
no index can prune: a search of that radius meets every fingerprint. Its words
weigh the shingles by heavy-tailed draws instead, so that near copies agree in
whole words, within one bit; with six words a pair at just 0.8 is proposed with
a chance of 0.998, whatever else the table holds. Proposed texts are compared by
their sets, which alone decide; large groups by several tasks, in blocks.

Defined results: null and blank texts have the zero fingerprint and link like
any other (in the copy search: are copies of each other); rows that repeat a
doc_id stay separate rows; a null doc_id gets a fingerprint but is a component's
id only where there is no other; an empty table gives no rows; other columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.shingles import Sets, alike, mix, seeds, set_numbers, shingle_sets
from boxloom.llm.text import give_back, slices, words
from boxloom.operators.graph import connected_components
from boxloom.runtime import drop_tables, sized_broadcast, write_table

FANOUT = 16
#: Comparisons made at once.
BLOCK = 1 << 20
_HALVES = 0x0000000100000001


def _name(i: int) -> str:
    return f"w{i}"


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the fingerprint w0 (a long) of every row of ``docs``."""
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("_row"),
        words(F.col(text_col)).alias("_words"),
    )
    last = F.greatest(F.size("_words") - F.lit(shingle), F.lit(0))
    places = base.select("doc_id", "_row", "_words", F.explode(F.sequence(F.lit(0), last)).alias("_at"))
    # get() is null beyond the end and concat_ws skips nulls: a shorter text is one shingle of all its words
    grams = places.select("doc_id", "_row", F.when(F.size("_words") > 0, F.concat_ws(" ", *[F.get("_words", F.col("_at") + i) for i in range(shingle)])).alias("_gram"))
    hashed = grams.select("doc_id", "_row", F.when(F.col("_gram").isNotNull(), F.xxhash64("_gram")).alias("_h"))
    sums = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(_HALVES))).alias(f"_s{i}") for i in range(32)]
    counted = hashed.groupBy("_row", "doc_id").agg(F.count("_h").alias("_n"), *sums)
    word = F.lit(0).cast("long")
    for i in range(32):
        for count, bit in ((F.col(f"_s{i}").bitwiseAND(F.lit(0xFFFFFFFF)), i), (F.shiftrightunsigned(f"_s{i}", 32), i + 32)):
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            word = word.bitwiseOR(F.when(count * 2 > F.col("_n"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select("doc_id", word.alias(_name(0)))


def hex_digits(word: Column) -> Column:
    return F.lpad(F.lower(F.hex(word)), 16, "0")


def gray_rank(word: Column) -> Column:
    """The place of a code word in Gray order, as a signed long that sorts alike."""
    for shift in (1, 2, 4, 8, 16, 32):
        word = word.bitwiseXOR(F.shiftrightunsigned(word, shift))
    return word.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def orders(radius: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The orders in which a search of ``radius`` sorts the bits: (leading bits, blocks as (lowest bit, width), first block leading).

    The 64 bits are cut into radius + 2 blocks. Two fingerprints within the
    radius agree wholly in two blocks at least, and each pair of blocks leads
    one order: whatever is within the radius shares the leading bits somewhere.
    """
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    out = []
    for pair in combinations(range(n), 2):
        led = [blocks[i] for i in pair]
        out.append((sum(w for _, w in led), led + [b for i, b in enumerate(blocks) if i not in pair]))
    return out


def _reordered(word: Column, blocks: list[tuple[int, int]]) -> Column:
    """``word`` with its blocks one after the other, the first on top."""
    out, top = F.lit(0).cast("long"), 64
    for low, width in blocks:
        top -= width
        part = F.shiftrightunsigned(word, low).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(part, top))
    return out


class GrayIndex:
    """The hierarchical index of fingerprints in Gray order: ``FANOUT`` neighbours form a node, as many nodes one above.

    A node knows the bits that all below it share. Keys are different from each
    other, so that one has no more than a ball of the radius full of neighbours.
    """

    def __init__(self, keys: np.ndarray, radius: int):
        self.keys, self.radius = keys, radius
        both, any_ = keys, keys
        self.levels = []  # (shared pattern, mask of shared bits), leaves' parents first
        while len(both) > FANOUT or not self.levels:
            cuts = np.arange(0, len(both), FANOUT)
            both, any_ = np.bitwise_and.reduceat(both, cuts), np.bitwise_or.reduceat(any_, cuts)
            mask = ~(both ^ any_)
            self.levels.append((both & mask, mask))

    def pairs(self, lo: int = 0, hi: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (a, b), a < b, of all pairs within the radius, in blocks; ``lo`` and ``hi`` bound a."""
        todo = [(lo, len(self.keys) if hi is None else hi)]
        while todo:
            lo, hi = todo.pop()
            found = self._descend(lo, hi)
            if found is None:  # more than a block of nodes is met at once: fewer are sought at a time
                middle = (lo + hi) // 2
                todo += [(middle, hi), (lo, middle)]
            elif len(found[0]):
                yield found

    def _descend(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray] | None:
        n = hi - lo
        top = len(self.levels[-1][0])
        who, node = np.repeat(np.arange(lo, hi), top), np.tile(np.arange(top), n)
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, mask = self.levels[depth]
            below = len(self.levels[depth - 1][0]) if depth else len(self.keys)
            # differences in the bits a node shares add up on the way down; all below a node before ``who`` has asked already
            keep = (np.bitwise_count((self.keys[who] ^ pattern[node]) & mask[node]) <= self.radius) & ((node + 1) * FANOUT ** (depth + 1) > who)
            if n > 1 and np.count_nonzero(keep) * FANOUT > BLOCK:
                return None
            who, node = np.repeat(who[keep], FANOUT), (node[keep][:, None] * FANOUT + np.arange(FANOUT)).ravel()
            inside = node < below
            who, node = who[inside], node[inside]
        keep = (node > who) & (np.bitwise_count(self.keys[who] ^ self.keys[node]) <= self.radius)
        return who[keep], node[keep]


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i] in place; roots are the smallest places."""
    while len(a):
        a, b = parent[a], parent[b]
        while True:
            up, vp = parent[a], parent[b]
            if np.array_equal(up, a) and np.array_equal(vp, b):
                break
            a, b = up, vp
        differ = a != b
        a, b = a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _forest(keys: np.ndarray, reps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what pairs within the radius join, one fewer than members at most."""
    parent = np.arange(len(keys))
    for a, b in GrayIndex(keys, radius).pairs():
        _union(parent, a, b)
    while not np.array_equal(parent, parent[parent]):
        parent = parent[parent]
    moved = parent != np.arange(len(parent))
    return reps[moved], reps[parent[moved]]


def _searcher(radius: int, leads: list[int]):
    """Links of rows sorted by order and Gray rank, group by group of those that share the leading bits."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
    shifts = np.array([64 - n for n in leads], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b)], schema=schema)

        held: list[tuple[np.ndarray, np.ndarray]] = []  # the group that may go on in the next batch
        at = None
        for batch in batches:
            tag, rep = batch.column("tag").to_numpy(), batch.column("rep").to_numpy()
            key = batch.column("key").to_numpy().view(np.uint64)
            lead = key >> shifts[tag % len(shifts)] if leads[0] < 64 else key
            edges = np.r_[0, np.flatnonzero((tag[1:] != tag[:-1]) | (lead[1:] != lead[:-1])) + 1, len(tag)]
            sizes = np.diff(edges)
            if held and (tag[0], lead[0]) != at:
                yield from out(*_forest(*map(np.concatenate, zip(*held, strict=True)), radius))
                held = []
            for i in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) % max(len(sizes) - 1, 1) == 0)):
                part = (key[edges[i] : edges[i + 1]].copy(), rep[edges[i] : edges[i + 1]].copy())
                if i == 0 and held:
                    part = tuple(map(np.concatenate, zip(*held, part, strict=True))) if len(sizes) > 1 else part
                    held = held if len(sizes) == 1 else []
                if i == len(sizes) - 1:
                    held.append(part)
                elif len(part[0]) > 1:
                    yield from out(*_forest(*part, radius))
            at = (tag[-1], lead[-1])
            del batch, tag, rep
            give_back()
        if held:
            yield from out(*_forest(*map(np.concatenate, zip(*held, strict=True)), radius))

    return run


def near_links(distinct: DataFrame, radius: int, rows: int = 1 << 20) -> DataFrame:
    """A spanning set of links (src, dst: values of ``rep``) between fingerprints within ``radius`` and of the same ``kind``.

    ``distinct``: a written table of kind (int), rep (long) and key (long); each
    key once a kind. Every key stands in all :func:`orders`; those that share
    an order's leading bits meet in one task, sorted by Gray rank. A task gets
    about ``rows`` of them, and holds one group of equal leading bits at a time.
    """
    spark, kinds = distinct.sparkSession, orders(radius)
    copies = F.array(*[F.struct(F.lit(i).alias("order"), _reordered(F.col("key"), blocks).alias("key")) for i, (_, blocks) in enumerate(kinds)])
    dealt = distinct.select("kind", "rep", F.explode(copies).alias("c")).select((F.col("kind") * len(kinds) + F.col("c.order")).alias("tag"), "rep", F.col("c.key").alias("key"))
    lead = F.lit(0).cast("long")
    for i, (n, _) in enumerate(kinds):
        lead = F.when(F.pmod("tag", F.lit(len(kinds))) == i, F.shiftrightunsigned("key", 64 - n) if n < 64 else F.col("key")).otherwise(lead)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() * len(kinds) // rows))
    met = dealt.withColumn("lead", lead).repartition(parts, "tag", "lead").sortWithinPartitions("tag", gray_rank(F.col("key")))
    return met.select("tag", "rep", "key").mapInArrow(_searcher(radius, [n for n, _ in kinds]), "src long, dst long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, w0 and component_id (the smallest doc_id reachable over links) of every row."""
    marks = write_table(fingerprints(docs, shingle, id_col, text_col), "marks")
    distinct = write_table(marks.groupBy("w0").agg(F.min("doc_id").alias("rep")).select(F.lit(0).alias("kind"), "rep", F.col("w0").alias("key")), "distinct")
    found = connected_components(near_links(distinct.where("rep is not null"), radius))
    known = distinct.join(found, distinct["rep"] == found["node"], "left").select(F.col("key").alias("w0"), F.coalesce("component", "rep").alias("component_id"))
    return marks.join(known, "w0", "left").select("doc_id", "w0", "component_id")


#: The fingerprint of a copy search: words, and shingles that have a part in each.
COPY_WORDS, COPY_TOP = 6, 8
#: Differing bits of one word at which two texts are compared.
COPY_RADIUS = 1
#: The Jaccard similarity that links, as a fraction.
ALIKE = (4, 5)
#: Two words of plain SimHash, and the differing bits of 128 at which sets are still compared one by one. At a similarity
#: of 0.8 sets differ in 19 bits on average, at worst (four shingles against five) in 24; the standard deviation is 4.
PLAIN_WORDS, PLAIN_RADIUS = 2, 40
_KEY = ["doc_id", "t0", "t1"]


def copy_words(sets: Sets) -> np.ndarray:
    """SimHash words over weighted shingles, one row a set.

    In each word a shingle has a weight of its own, the square of 1 / u with u
    drawn uniformly by its number, as alike in every text. Such weights have a
    heavy tail: a word hangs on a text's few heaviest shingles (the first
    ``COPY_TOP`` are summed, the rest would not add 1 %), so that two sets with
    a similarity of 0.8 agree in a word but for one bit with a chance of 0.65,
    where equal weights would leave a tenth of that.
    """
    n, sizes = len(sets), sets.sizes
    doc = np.repeat(np.arange(n), sizes)
    limit = np.where(sizes > 48, np.uint64(2**64 - 1) // np.maximum(sizes, 1).astype(np.uint64) * np.uint64(48), np.uint64(2**64 - 1))
    out = np.zeros((n, COPY_WORDS), np.uint64)
    for w, seed in enumerate(seeds(COPY_WORDS, 3)):
        draw = mix(sets.numbers ^ seed)
        keep = draw <= limit[doc]
        poor = np.bincount(doc[keep], minlength=n) < np.minimum(sizes, COPY_TOP)
        if poor.any():
            keep |= poor[doc]
        own, drawn = doc[keep], draw[keep]
        order = np.lexsort((drawn, own))
        own, drawn = own[order], drawn[order]
        count = np.bincount(own, minlength=n)
        rank = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        first = rank < COPY_TOP
        table, held = np.zeros((n, COPY_TOP), np.uint64), np.zeros((n, COPY_TOP), bool)
        table[own[first], rank[first]] = drawn[first]
        held[own[first], rank[first]] = True
        u = (table.astype(np.float64) + 1.0) / 2.0**64
        weight = np.where(held, (u[:, :1] / u) ** 2, 0.0)
        votes = np.zeros((n, 64))
        for r in range(COPY_TOP):
            bits = np.unpackbits(mix(table[:, r] ^ ~seed).view(np.uint8).reshape(n, 8), axis=1)
            votes += weight[:, r, None] * (bits * 2.0 - 1.0)
        # words of different kinds never meet; the seed keeps their values apart as well
        out[:, w] = np.packbits(votes > 0, axis=1).view(np.uint64).ravel() ^ seed
    return out


def plain_words(sets: Sets) -> np.ndarray:
    """SimHash words in which all shingles weigh the same, one row a set."""
    out = np.zeros((len(sets), PLAIN_WORDS), np.uint64)
    for w, seed in enumerate(seeds(PLAIN_WORDS, 4)):
        bits = np.unpackbits(mix(sets.numbers ^ seed).view(np.uint8).reshape(-1, 8), axis=1)
        for i, (lo, hi) in enumerate(zip(sets.at[:-1].tolist(), sets.at[1:].tolist(), strict=True)):
            out[i, w] = np.packbits(bits[lo:hi].sum(axis=0, dtype=np.int32) * 2 > hi - lo).view(np.uint64)[0]
    return out


def _marker(shingle: int):
    names = ["doc_id", "t0", "t1", "s0", "s1", "size", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            sets = shingle_sets(batch.column(3), shingle)
            s0, s1 = set_numbers(sets)
            flat = pa.array(copy_words(sets).view(np.int64).ravel())
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * COPY_WORDS), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(s0.view(np.int64)), pa.array(s1.view(np.int64)), pa.array(sets.sizes.astype(np.int64)), listed], names=names)

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str, *others: Column) -> DataFrame:
    """doc_id and two hashes of the text, by which rows are known; null counts as the empty text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.lit(0), text).alias("t0"), F.xxhash64(F.lit(1), text).alias("t1"), text.alias("text"), *others)


class _SetCell:
    """Members of a cell with their shingle sets, joined as far as their sets are alike."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
        self.prints = None

    def _met(self, node: int, print_: np.ndarray, set_: np.ndarray, end: int) -> Iterator[int]:
        """One member alike of each set of joined members, among the first ``end``."""
        far = np.bitwise_count(self.prints[:end] ^ print_).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(far <= PLAIN_RADIUS)
        while len(near):
            at = int(near[0])
            if self.nodes[at] == node or alike(self.sets[at], set_, ALIKE):
                near = near[self.label[near] != self.label[at]]
                yield at
            else:
                near = near[1:]

    def build(self) -> Iterator[tuple[int, int]]:
        self.nodes, self.prints = (np.concatenate([p[i] for p in self.parts]) for i in range(2))
        self.sets = [x for p in self.parts for x in p[2]]
        self.parts, self.label = [], np.arange(len(self.nodes))
        for i in range(1, len(self.nodes)):
            for at in list(self._met(self.nodes[i], self.prints[i], self.sets[i], i)):
                yield int(self.nodes[at]), int(self.nodes[i])
                self.label[self.label == self.label[at]] = i

    def probe(self, nodes: np.ndarray, prints: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        for node, print_, set_ in zip(nodes, prints, sets, strict=True):
            for at in self._met(node, print_, set_, len(self.nodes)):
                yield int(self.nodes[at]), int(node)


def _verifier(shingle: int):
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs: Iterable[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            pairs = list(pairs)
            if pairs:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], schema=schema)

        cell, at = None, None
        for batch in slices(batches, 4):
            label, block, query, node = (batch.column(n).to_numpy() for n in ("label", "block", "query", "node"))
            sets = shingle_sets(batch.column(4), shingle)
            prints = plain_words(sets)
            edges = np.r_[0, np.flatnonzero((label[1:] != label[:-1]) | (block[1:] != block[:-1]) | (query[1:] != query[:-1])) + 1, len(label)]
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = (node[lo:hi].copy(), prints[lo:hi], [sets[i].copy() for i in range(lo, hi)])
                if at != (label[lo], block[lo]):
                    if cell is not None and cell.prints is None:
                        yield from out(cell.build())
                    cell, at = _SetCell(), (label[lo], block[lo])
                if query[lo]:
                    if cell.prints is None:
                        yield from out(cell.build())
                    yield from out(cell.probe(*part))
                else:
                    cell.parts.append(part)
        if cell is not None and cell.prints is None:
            yield from out(cell.build())

    return run


def _candidates(nodes: DataFrame, block: int) -> DataFrame:
    """node and the array of (label, blocks) under which it is to be compared, a written table. ``nodes``: a written table of node, size and words."""
    words_ = nodes.select("node", "size", F.posexplode("words").alias("kind", "key"))
    prints = write_table(words_.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")), "prints")
    near = connected_components(near_links(prints.select("kind", F.col("key").alias("rep"), "key"), COPY_RADIUS))
    groups = near.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    joined = near.join(groups, "component").where("m > 1").select(F.col("node").alias("key"), F.col("component").alias("label"))
    shared = prints.join(joined, "key", "left").where("n > 1 or label is not null").select("kind", "key", F.coalesce("label", "key").alias("label"))
    labelled = write_table(words_.join(shared, ["kind", "key"]).select("label", "node", "size"), "labelled")
    # groups of the same members, found by several words, are compared once
    same = F.bit_xor(F.xxhash64("node")).alias("members")
    told = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), same).where("n > 1")
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("size") / (block * 1024))).cast("int")
    kept = told.groupBy("n", "members").agg(F.min("label").alias("label"), F.min(blocks).alias("blocks"))
    found = write_table(labelled.join(kept, "label").groupBy("node").agg(F.collect_set(F.struct("label", "blocks")).alias("labels")), "sought")
    drop_tables(prints, near, labelled)
    return found


#: Members of a block's component that speak for it before all are asked.
SPEAKERS = 32


def _links(met: DataFrame, places: Column, shingle: int) -> DataFrame:
    """Links between texts alike that meet in a block of a label. ``met``: label, blocks, own, node and text; ``places``: the blocks each goes to, as struct(block, query)."""
    dealt = met.select("label", F.explode(places).alias("p"), "node", "text").select("label", "p.block", "p.query", "node", "text")
    together = dealt.repartition("label", "block").sortWithinPartitions("label", "block", "query", "node")
    return together.mapInArrow(_verifier(shingle), "src long, dst long").where("src <> dst")


def _joined(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` (label, blocks, own, node) with the component that links have made of each node so far."""
    known = connected_components(links).withColumnRenamed("node", "known")
    return members.join(known, F.col("node") == F.col("known"), "left").withColumn("component", F.coalesce("component", "node")).drop("known")


def _verified(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """A written table of links that join the texts alike of every label. ``docs``: rows by :func:`_keyed`; ``wanted``: their keys with node and labels.

    A label of several blocks is joined block by block. Then a few members of
    each block's components meet those of the other blocks, which joins a group
    of copies. What is not in the label's largest component by then goes to
    every block: of two members in different blocks, one does, or both are
    joined already. So no link that matters is missed, and the texts sent are in
    proportion to a group of copies, whatever its size.
    """
    on = F.col("doc_id").eqNullSafe(F.col("k0")) & (F.col("t0") == F.col("k1")) & (F.col("t1") == F.col("k2"))
    used = []

    def kept(rows: DataFrame, name: str) -> DataFrame:
        used.append(write_table(rows, name))
        return used[-1]

    def with_texts(members: DataFrame) -> DataFrame:
        keys = wanted.select(F.col("node").alias("of"), "k0", "k1", "k2")
        chosen = kept(members.join(keys, F.col("node") == F.col("of")).drop("of"), "members")
        return docs.join(sized_broadcast(chosen, row_bytes=256), on).select("label", "blocks", "own", "node", "text")

    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = kept(wanted.select("node", F.inline("labels")).withColumn("own", own), "labels")
    here = F.array(F.struct(F.col("own").alias("block"), F.lit(0).alias("query")))
    inside = write_table(_links(with_texts(members), here, shingle), "inside")
    many = members.where("blocks > 1")
    if many.isEmpty():
        drop_tables(*used)
        return inside
    rank = F.row_number().over(Window.partitionBy("label", "own", "component").orderBy(F.xxhash64("node"), "node"))
    speakers = _joined(many, inside).withColumn("rank", rank).where(F.col("rank") <= SPEAKERS).drop("rank", "component")
    seats = F.pmod(F.xxhash64("node", F.lit("seat")), F.col("seats")).cast("int")
    sizes = speakers.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / 4096).cast("int").alias("seats"))
    seated = speakers.join(sizes, "label").select("label", F.col("seats").alias("blocks"), seats.alias("own"), "node")
    asked = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: (b != F.col("own")) & ((F.col("own") < b) == ((F.col("own") + b) % 2 == 0)))
    halves = F.concat(here, F.transform(asked, lambda b: F.struct(b.alias("block"), F.lit(1).alias("query"))))
    between = write_table(inside.unionByName(_links(with_texts(seated), halves, shingle)), "between")
    placed = kept(_joined(many, between), "placed")
    largest = placed.groupBy("label", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.max(F.struct("n", "component"))["component"].alias("largest"), F.count(F.lit(1)).alias("left"))
    split = placed.join(largest.where("left > 1"), "label").withColumn("stray", F.col("component") != F.col("largest"))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.when(b == F.col("own"), 0).otherwise(1).alias("query")))
    apart = split.select("label", F.when(F.col("stray"), F.col("blocks")).otherwise(-F.col("blocks")).alias("blocks"), "own", "node")
    met = with_texts(apart).withColumn("stray", F.col("blocks") > 0).withColumn("blocks", F.abs("blocks"))
    links = write_table(between.unionByName(_links(met, F.when(F.col("stray"), every).otherwise(here), shingle)), "links")
    drop_tables(*used, inside, between)
    return links


def _classes(docs: DataFrame, shingle: int, block: int, id_col: str, text_col: str) -> DataFrame:
    """A written table of every row's key, and the key of the row that stands for its near copies (k0, k1, k2)."""
    keyed = _keyed(docs, id_col, text_col)
    marks = write_table(keyed.select(*_KEY, "text").mapInArrow(_marker(shingle), "doc_id long, t0 long, t1 long, s0 long, s1 long, size long, words array<long>"), "marks")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *_KEY)).alias("first")
    found = marks.groupBy("s0", "s1").agg(first, F.max("size").alias("size"), F.max("words").alias("words"))
    nodes = write_table(found.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    sought = _candidates(nodes.where("size > 0"), block)
    wanted = write_table(nodes.join(sought, "node").select("node", F.col("first.doc_id").alias("k0"), F.col("first.t0").alias("k1"), F.col("first.t1").alias("k2"), "labels"), "wanted")
    links = _verified(keyed, wanted, shingle)
    components = connected_components(links)
    joined = nodes.join(components, "node", "left").select("s0", "s1", F.coalesce("component", "node").alias("group"), "first")
    least = joined.groupBy("group").agg(F.min("first").alias("least"))
    # each table goes as soon as nothing reads it
    known = joined.join(least, "group").select("s0", "s1", F.col("least.doc_id").alias("k0"), F.col("least.t0").alias("k1"), F.col("least.t1").alias("k2"))
    classes = write_table(marks.select(*_KEY, "s0", "s1").join(known, ["s0", "s1"]).select(*_KEY, "k0", "k1", "k2"), "classes")
    drop_tables(marks, nodes, sought, wanted, links, components)
    return classes


def near_copies(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """doc_id and component_id (the least doc_id of those joined, null if all are) of every row.

    Documents whose sets of shingles have a Jaccard similarity of 0.8 or more
    are linked. Fingerprints (:func:`copy_words`) propose pairs; the sets
    themselves decide. A group of more than ``block`` proposed texts is compared
    in blocks by as many tasks.
    """
    return _classes(docs, shingle, block, id_col, text_col).select("doc_id", F.col("k0").alias("component_id"))


def without_copies(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the least doc_id, a null one only where there is no other.

    Of rows alike in doc_id and text one stays.
    """
    classes = _classes(docs, shingle, block, id_col, text_col)
    own = F.col("doc_id").eqNullSafe(F.col("k0")) & (F.col("t0") == F.col("k1")) & (F.col("t1") == F.col("k2"))
    gone = classes.where(~own).select(F.col("doc_id").alias("g0"), F.col("t0").alias("g1"), F.col("t1").alias("g2")).distinct()
    repeated = classes.groupBy(*_KEY).count().where("count > 1").select(F.col("doc_id").alias("g0"), F.col("t0").alias("g1"), F.col("t1").alias("g2"))
    columns = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*columns)
    id_, text = columns[docs.columns.index(id_col)], columns[docs.columns.index(text_col)]
    keyed = _keyed(plain, id_, text, *map(F.col, columns)).drop("text")
    on = F.col("doc_id").eqNullSafe(F.col("g0")) & (F.col("t0") == F.col("g1")) & (F.col("t1") == F.col("g2"))
    kept = keyed.join(sized_broadcast(write_table(gone, "gone")), on, "left_anti")
    again = write_table(repeated, "repeated")
    if not again.isEmpty():
        twice = kept.join(sized_broadcast(again), on, "left_semi").dropDuplicates(_KEY)
        kept = kept.join(sized_broadcast(again), on, "left_anti").unionByName(twice)
    return kept.select(*columns).toDF(*docs.columns)
