"""Document fingerprints from closed syncmers.

A k-mer (``k`` consecutive code points) is a closed syncmer if the least hash
among its s-mers is that of the first or of the last one. The choice looks at
nothing outside the k-mer, so a passage keeps its anchors wherever it stands.
With 2s >= k the first and the last s-mer cover the k-mer, and their two hashes
give its own.

A fingerprint keeps, of ``bins`` bins of syncmer hashes, the least hash of each:
10 hex digits a filled bin, two for the bin and eight for the hash. The likeness
of two fingerprints is the share of bins with the same hash among those that
either fills: an unbiased estimate of the overlap of the syncmer sets. Two empty
fingerprints are alike (1.0); an empty and a full one are not (0.0).

Native: JVM expressions only; the texts cross the network once.

Defined results: null counts as the empty text; a text shorter than ``k`` is one
anchor; rows that repeat a doc_id are told apart by their text and stand next to
each other; a null doc_id sorts first; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S, BINS = 12, 8, 64
#: Rows a bucket of neighbouring documents holds, about, and buckets at most.
BUCKET, BUCKETS = 400, 4096


def _smer(i: int, s: int) -> Column:
    """The hash of the s-mer ``i`` places into the k-mer at ``pos``; ``_wide`` has four bytes a code point, so that a slice costs the same anywhere."""
    return F.xxhash64(F.substring(F.col("_wide"), F.col("pos") * 4 + (4 * i + 1), F.lit(4 * s)))


def _syncmers(places: DataFrame, keep: list[Column], k: int, s: int, also: Column, value: Column) -> DataFrame:
    """Of rows with _text, _wide, _n and pos those that are closed syncmers (or ``also``): ``keep`` and hash (``value`` where ``also``).

    Each s-mer is hashed once to decide; the few kept rows hash two again.
    """
    if not s < k <= 2 * s:
        raise ValueError("k must be above s, and 2s at most")
    w = k - s + 1
    edge = F.least(_smer(0, s), _smer(w - 1, s))
    inner = [_smer(i, s) for i in range(1, w - 1)]
    closed = edge <= (inner[0] if len(inner) == 1 else F.least(*inner)) if inner else F.lit(True)
    short = F.col("_n") < k
    made = F.when(also, value).when(short, F.xxhash64("_text")).otherwise(F.xxhash64(_smer(0, s), _smer(w - 1, s)))
    return places.where(also | short | closed).select(*keep, made.alias("hash"))


def _prepared(texts: DataFrame, keep: list[str], text: str) -> DataFrame:
    return texts.select(*keep, F.col(text).alias("_text"), F.encode(text, "UTF-32").alias("_wide"), F.char_length(text).alias("_n"))


def anchors(texts: DataFrame, text: str, keep: list[str], k: int = K, s: int = S) -> DataFrame:
    """The columns ``keep`` with pos and hash of every closed syncmer of ``text``."""
    last = F.greatest(F.col("_n") - k, F.lit(0))
    places = _prepared(texts, keep, text).where("_n > 0").select("*", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    return _syncmers(places, [*map(F.col, keep), F.col("pos")], k, s, F.lit(False), F.lit(0).cast("long"))


def digits(marks: Column) -> Column:
    return F.array_join(F.transform(marks, lambda m: F.lpad(F.lower(F.hex(m)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Of two marks, 0 to 1."""

    def bins(marks: Column) -> Column:
        return F.transform(marks, lambda m: F.shiftrightunsigned(m, 32))

    full = F.size(F.array_union(bins(a), bins(b)))
    return F.when(full == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / full).cast("double")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S, bins: int = BINS) -> DataFrame:
    """doc_id, marks and fingerprint of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    made = _sketch_with(rows, ["_row"], ["doc_id"], k, s, bins)
    return made.select("doc_id", "marks", digits(F.col("marks")).alias("fingerprint"))


def _bucketed(rows: DataFrame, edges: list[float]) -> DataFrame:
    """``rows`` with _bucket: how many of the sorted edges are at or below doc_id, found by halving."""
    out = rows.withColumn("_bucket", F.lit(0))
    if not edges:
        return out
    known = F.array(*[F.lit(float(e)) for e in edges])
    step = 1 << (len(edges).bit_length() - 1)
    while step:
        below = F.get(known, F.col("_bucket") + F.lit(step - 1)) <= F.col("doc_id")
        out = out.withColumn("_bucket", F.col("_bucket") + F.when(below, F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    return out


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S, bins: int = BINS) -> DataFrame:
    """Every document beside its edited text and the next document.

    The edited text has its last floor(n / 2) code points replaced by the first
    as many (or all) of the next document in ascending doc_id, which after the
    last is the first. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next.

    Neighbours are brought together by buckets of the doc_id order, whose edges
    are approximate quantiles (``BUCKETS`` numbers at most); each bucket also
    gets a copy of the next one's first document. Everything else happens
    inside the buckets.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.count()
    if not total:
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_chars"), *[F.lit("").alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[F.lit(0.0).alias(c) for c in ("near_edited", "near_next")])
    parts = max(1, min(BUCKETS, total // BUCKET))
    edges = sorted(set(docs.where(F.col(id_col).isNotNull()).approxQuantile(id_col, [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    # a text's hash tells rows of one doc_id apart; rows alike in both are the same row
    placed = _bucketed(rows, edges).select(F.coalesce("_bucket", F.lit(0)).alias("_bucket"), "doc_id", F.xxhash64("text").alias("_hash"), "text", F.lit(0).alias("_border"))
    starts = sorted((r["_bucket"], r["first"]) for r in placed.groupBy("_bucket").agg(F.min(F.struct("doc_id", "_hash")).alias("first")).collect())
    spark = docs.sparkSession
    moved = [(starts[i - 1][0], first["doc_id"], first["_hash"]) for i, (_, first) in enumerate(starts)]
    heads = spark.createDataFrame(moved, "_to int, _id long, _head long")
    borders = (
        placed.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_head")))
        .dropDuplicates(["_to"])
        .select(F.col("_to").alias("_bucket"), "doc_id", "_hash", "text", F.lit(1).alias("_border"))
    )
    order = Window.partitionBy("_bucket").orderBy("_border", F.col("doc_id").asc_nulls_first(), "_hash")
    neighbours = placed.unionByName(borders).select("_bucket", "_border", "doc_id", "text", F.row_number().over(order).alias("_at"), F.lead("text").over(order).alias("_next"))
    n = F.char_length("text")
    moved_n = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - moved_n), F.substring(F.col("_next"), F.lit(1), moved_n))
    pairs = neighbours.select("_bucket", "_border", "doc_id", "_at", "text", n.cast("long").alias("n_chars"), F.coalesce(edited, F.lit("")).alias("_edited"))
    # the digest as eight numbers: an aggregate over numbers alone needs no sort
    digest = F.sha2(F.col("_edited"), 256)
    numbers = [F.conv(F.substring(F.col("_digest"), 8 * i + 1, 8), 16, 10).cast("long").alias(f"_d{i}") for i in range(8)]
    told = pairs.select("_bucket", "_at", "_border", "doc_id", "n_chars", "text", "_edited", digest.alias("_digest"))
    facts = ["_border", "doc_id", "n_chars", *[f"_d{i}" for i in range(8)]]
    versions = told.select("_bucket", "_at", *facts[:3], *numbers, F.posexplode(F.array("text", "_edited")).alias("_kind", "_text"))
    keys = ["_bucket", "_at", "_kind"]
    sketched = _sketch_with(versions, keys, facts, k, s, bins)
    along = Window.partitionBy("_bucket").orderBy("_at", "_kind")
    told = sketched.select("*", F.lead("marks", 1).over(along).alias("_own_edit"), F.lead("marks", 2).over(along).alias("_after"))
    sha = F.concat(*[F.lpad(F.lower(F.hex(f"_d{i}")), 8, "0") for i in range(8)])
    return told.where("_kind = 0 and _border = 0").select(
        "doc_id", "n_chars", sha.alias("edited_sha256"),
        digits(F.col("marks")).alias("fingerprint"), digits(F.col("_own_edit")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("_own_edit")).alias("near_edited"), likeness(F.col("marks"), F.col("_after")).alias("near_next"),
    )


def _sketch_with(texts: DataFrame, keys: list[str], facts: list[str], k: int, s: int, bins: int) -> DataFrame:
    """``keys``, ``facts`` (numbers) and marks (bin and least hash in one long, by bin) of every row.

    The facts take places before a text's first, and negative bins after that,
    so that one least number a bin is all there is to aggregate.
    """
    n = len(facts)
    last = F.when(F.col("_n") > 0, F.greatest(F.col("_n") - k, F.lit(0))).otherwise(F.lit(-1))
    places = _prepared(texts, [*keys, *facts], "_text").select("*", F.explode(F.sequence(F.lit(-n), last)).alias("pos"))
    told = F.lit(None).cast("long")
    for i, c in enumerate(facts):
        told = F.when(F.col("pos") == i - n, F.col(c).cast("long")).otherwise(told)
    is_fact = F.col("pos") < 0
    found = _syncmers(places, [*map(F.col, keys), F.when(is_fact, F.col("pos")).otherwise(F.lit(0)).alias("_fact")], k, s, is_fact, told)
    bin_ = F.when(F.col("_fact") < 0, F.col("_fact")).otherwise(F.pmod("hash", F.lit(bins)).cast("int"))
    value = F.when(F.col("_fact") < 0, F.col("hash")).otherwise(F.shiftrightunsigned("hash", 32))
    least = found.select(*keys, bin_.alias("_bin"), value.alias("_value")).groupBy(*keys, "_bin").agg(F.min("_value").alias("_value"))
    listed = least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_bin", "_value"))).alias("_all"))
    marks = F.transform(F.filter("_all", lambda e: e["_bin"] >= 0), lambda e: F.shiftleft(e["_bin"].cast("long"), 32).bitwiseOR(e["_value"]))
    return listed.select(*keys, *[F.get("_all", F.lit(i))["_value"].alias(c) for i, c in enumerate(facts)], marks.alias("marks"))
