"""The registered queries of the annotation operators and their SQL.

The supplied tables have no images, so boxes come from ``lineitem``: each four
lines of an order are the objects of an image, an order without lines is an
image without objects, and predictions are the same boxes shifted, dropped
(return flag R) or doubled (A). ``documents`` stands for image files.
Query and SQL derive them in the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxloom.functions import boxes as B
from boxloom.functions.detections import parsed
from boxloom.functions.exact import exact_means
from boxloom.functions.hashing import group_key, safe_name, stable_hash
from boxloom.functions.sizes import preflight, resized, visual_tokens
from boxloom.operators import checks, coverage, grouping, pairing, report, schedule, scoring, splits
from boxloom.plans import gates, predict, runs
from boxloom.runtime import new_path, write_table
from boxloom.sources import files, voc
from boxloom.streaming import runs as followed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEED = 17


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- derived data

LINES = """
lines AS (
  SELECT l_orderkey * 1000 + (n - 1) // 4 AS k, (n - 1) % 4 + 1 AS rn, l_linenumber AS ln, l_returnflag AS flag, (l_partkey * 7) % 800 AS x1, (l_suppkey * 13) % 800 AS y1, CAST(60 + 2 * l_quantity AS INTEGER) AS side
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS n FROM lineitem)),
truth AS (SELECT k, rn, ln, flag, x1, y1, x1 + side AS x2, y1 + side AS y2 FROM lines),
images AS (SELECT k FROM truth UNION SELECT o_orderkey * 1000 FROM orders),
preds AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY rn, c) AS i, x1 + d AS x1, y1 + d AS y1, x2 + d AS x2, y2 + d AS y2
  FROM (SELECT t.*, (ln % 4) * 4 AS d, c FROM truth t, (VALUES (1), (2)) v(c) WHERE flag <> 'R' AND (c = 1 OR flag = 'A')))
"""

IOU = """
iou AS (
  SELECT k, i, bit, w * h / (pa + ta - w * h) AS iou FROM (
    SELECT p.k, p.i, CAST(pow(2, t.rn - 1) AS BIGINT) AS bit,
      CAST(greatest(least(p.x2, t.x2) - greatest(p.x1, t.x1), 0) AS DOUBLE) AS w, CAST(greatest(least(p.y2, t.y2) - greatest(p.y1, t.y1), 0) AS DOUBLE) AS h,
      (p.x2 - p.x1) * (p.y2 - p.y1) AS pa, (t.x2 - t.x1) * (t.y2 - t.y1) AS ta
    FROM preds p JOIN truth t ON p.k = t.k)),
np AS (SELECT k, count(*) AS n FROM preds GROUP BY k),
nt AS (SELECT k, count(*) AS n FROM truth GROUP BY k)
"""


def _objects(rows: DataFrame, *more: str) -> DataFrame:
    """Lines with their place ``n`` in the order as objects: ``more``, k, rn, ln, flag and the box's sides."""
    x, y, side = (F.col("l_partkey") * 7) % 800, (F.col("l_suppkey") * 13) % 800, (60 + 2 * F.col("l_quantity")).cast("int")
    return rows.select(
        *more, (F.col("l_orderkey") * 1000 + F.floor(F.col("n") / 4)).alias("k"), (F.col("n") % 4 + 1).alias("rn"), F.col("l_linenumber").alias("ln"), F.col("l_returnflag").alias("flag"),
        x.cast("int").alias("x1"), y.cast("int").alias("y1"), (x + side).cast("int").alias("x2"), (y + side).cast("int").alias("y2"),
    )


_ORDER = ("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an object: k, rn, ln, flag and the box's sides."""
    order = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    return _objects(table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order) - 1))


def _side_box(prefix: str = "") -> Column:
    return B.box(*[F.col(f"{prefix}{s}") for s in ("x1", "y1", "x2", "y2")])


def _completion(boxes: str) -> Column:
    """The text of a detection set."""
    items = F.transform(boxes, lambda b: F.concat(F.lit('{"bbox_2d":['), F.array_join(F.transform(b, lambda v: v.cast("string")), ","), F.lit("]}")))
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an image: k, targets and predicted (sorted arrays of boxes), drawn (the targets by rn), and its completion; a few are invalid.

    Orders come in as bare rows beside their lines, so that numbering, grouping
    and the images without lines take one shuffle, by order. It is partitioned by
    number: few bytes, but much work each.
    """
    bought = table(spark, sf_dir, "lineitem").select("l_orderkey", *_ORDER, "l_returnflag", "l_quantity", F.lit(False).alias("bare"))
    empty = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("bare"))
    rows = bought.unionByName(empty, allowMissingColumns=True).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("bare", *_ORDER)  # bare rows last: they change no line's number
    placed = rows.withColumn("n", F.when(F.col("bare"), 0).otherwise(F.row_number().over(order) - 1))
    shown = F.when(~F.col("bare"), F.struct("rn", "ln", "flag", F.array("x1", "y1", "x2", "y2").alias("box")))
    # grouped by the order too, by which the rows are partitioned already
    by = _objects(placed, "l_orderkey", "bare").groupBy("l_orderkey", "k").agg(F.array_sort(F.collect_list(shown)).alias("objects"))

    def said(o: Column) -> Column:
        moved = F.transform(o["box"], lambda v: (v + (o["ln"] % 4) * 4).cast("int"))
        return F.when(o["flag"] == "R", F.array().cast("array<array<int>>")).when(o["flag"] == "A", F.array(moved, moved)).otherwise(F.array(moved))

    full = by.select("k", F.transform("objects", lambda o: o["box"]).alias("drawn"), F.array_sort(F.flatten(F.transform("objects", said))).alias("predicted"))
    text = _completion("predicted")
    return full.select("k", F.array_sort("drawn").alias("targets"), "drawn", "predicted", F.when(F.col("k") % 11 == 0, F.concat(F.lit("```json"), text, F.lit("```"))).otherwise(text).alias("raw_completion"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pixel_boxes`` are by rn: the slices' SQL adds up areas in this order, and sums of doubles depend on it."""
    return orders(spark, sf_dir).select(
        F.col("k").cast("string").alias("id"), F.concat(F.lit("c"), (F.col("k") % 3).cast("string")).alias("visual_concept"), F.lit("q").alias("query"), F.col("k").cast("string").alias("target_key"),
        F.lit("r0").alias("reference_key"), "targets", F.col("drawn").alias("pixel_boxes"), F.lit(1000).alias("width"), F.lit(1000).alias("height"), "raw_completion",
    )


# ---------------------------------------------------------------- boxes

@query(f"WITH {LINES} SELECT k, CAST(rn AS INTEGER) AS rn, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS area FROM truth")
def box_area(spark, sf_dir):
    return lines(spark, sf_dir).select("k", "rn", B.area(_side_box()).alias("area"))


@query(f"WITH {LINES}, {IOU} SELECT k, CAST(i AS INTEGER) AS i, bit, round(iou, 9) AS iou FROM iou WHERE iou > 0")
def iou_pairs(spark, sf_dir):
    rows = lines(spark, sf_dir)
    d = (F.col("ln") % 4) * 4
    copies = F.when(F.col("flag") == "R", F.array().cast("array<int>")).when(F.col("flag") == "A", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    preds = rows.select("*", F.explode(copies).alias("c")).withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("rn", "c")))
    preds = preds.select("k", "i", B.shifted(_side_box(), d, d).alias("p"))
    met = preds.join(rows.select("k", F.pow(F.lit(2.0), F.col("rn") - 1).cast("long").alias("bit"), _side_box().alias("t")), "k")
    iou = B.overlap(F.col("p"), F.col("t"))
    return met.select("k", "i", "bit", iou.alias("iou")).where("iou > 0").withColumn("iou", F.round("iou", 9))


@query(f"""WITH {LINES} SELECT k, CAST(rn AS INTEGER) AS rn, CAST(round(x1 / 997 * 1000) AS INTEGER) AS gx1, CAST(round(y1 / 991 * 1000) AS INTEGER) AS gy1,
  CAST(round(x2 / 997 * 1000) AS INTEGER) AS gx2, CAST(round(y2 / 991 * 1000) AS INTEGER) AS gy2 FROM (SELECT k, rn, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM truth)""")
def encode_grid(spark, sf_dir):
    grid = B.on_grid(_side_box(), F.lit(997), F.lit(991))
    return lines(spark, sf_dir).select("k", "rn", *[F.get(grid, F.lit(i)).alias(f"g{s}") for i, s in enumerate(("x1", "y1", "x2", "y2"))])


@query(f"""WITH {LINES} SELECT k, CAST(rn AS INTEGER) AS rn, round(least(x1 / 1000.0 * 640, 640), 6) AS px1, round(least(y1 / 1000.0 * 480, 480), 6) AS py1, round(least(x2 / 1000.0 * 640, 640), 6) AS px2, round(least(y2 / 1000.0 * 480, 480), 6) AS py2
  FROM (SELECT k, rn, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM truth)""")
def decode_grid(spark, sf_dir):
    pixel = B.from_grid(F.array("x1", "y1", "x2", "y2"), F.lit(640), F.lit(480))
    return lines(spark, sf_dir).select("k", "rn", *[F.round(pixel[s], 6).alias(f"p{s}") for s in ("x1", "y1", "x2", "y2")])


@query(f"""WITH {LINES} SELECT k, CAST(rn AS INTEGER) AS rn, CAST(least(x2, 500) - x1 AS DOUBLE) AS width, CAST(least(y2, 400) - y1 AS DOUBLE) AS height FROM truth WHERE x1 < 500 AND y1 < 400""")
def clamp_box(spark, sf_dir):
    inside = B.clamped(_side_box(), F.lit(500), F.lit(400))
    return lines(spark, sf_dir).select("k", "rn", (inside["x2"] - inside["x1"]).alias("width"), (inside["y2"] - inside["y1"]).alias("height")).where("width is not null")


@query(f"""WITH {LINES} SELECT k, CAST(rn AS INTEGER) AS rn, CAST(x1 - 1 AS DOUBLE) AS x1, CAST(y1 - 1 AS DOUBLE) AS y1 FROM truth WHERE x1 >= 1 AND y1 >= 1 AND x2 <= 900 AND y2 <= 900""")
def voc_semantics(spark, sf_dir):
    opened = B.from_annotation(_side_box(), F.lit(True), F.lit(900), F.lit(900))
    return lines(spark, sf_dir).select("k", "rn", opened.alias("o")).where("o is not null").select("k", "rn", F.col("o.x1").alias("x1"), F.col("o.y1").alias("y1"))


@query(f"""WITH {LINES} SELECT k, CAST(rn AS INTEGER) AS rn, CAST(round_even((x1 + 2) * 0.5, 0) AS INTEGER) AS x1, CAST(round_even((y2 + 3) * 0.25, 0) AS INTEGER) AS y2 FROM truth""")
def shift_scale(spark, sf_dir):
    moved = B.scaled(B.shifted(_side_box(), F.lit(2), F.lit(3)), F.lit(0.5), F.lit(0.25))
    whole = B.to_array(moved, rounded=True)
    return lines(spark, sf_dir).select("k", "rn", F.get(whole, F.lit(0)).alias("x1"), F.get(whole, F.lit(3)).alias("y2"))


# ---------------------------------------------------------------- parsing and matching

@query(f"""WITH {LINES}, np AS (SELECT k, count(*) AS n FROM preds GROUP BY k)
SELECT CAST(images.k AS VARCHAR) AS id, images.k % 11 <> 0 AS valid, CAST(CASE WHEN images.k % 11 = 0 THEN 0 ELSE coalesce(n, 0) END AS INTEGER) AS n_boxes FROM images LEFT JOIN np ON np.k = images.k""")
def strict_parse(spark, sf_dir):
    rows = examples(spark, sf_dir).select("id", parsed("raw_completion").alias("p"))
    return rows.select("id", F.col("p.valid").alias("valid"), F.size("p.boxes").alias("n_boxes"))


_MATCH = f"""
WITH RECURSIVE {LINES}, {IOU},
steps AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) AS t UNION ALL SELECT -1.0),
opts AS (
  SELECT k, i, CAST(t AS DOUBLE) AS t, bit, iou FROM iou, steps WHERE (t < 0 AND iou > 0) OR (t > 0 AND iou >= t)
  UNION ALL SELECT k, i, CAST(t AS DOUBLE), 0, 0.0 FROM preds, steps),
m AS (
  SELECT k, CAST(t AS DOUBLE) AS t, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS mask, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS s FROM np, steps
  UNION ALL
  SELECT m.k, m.t, m.i + 1, m.mask | o.bit, m.n + CASE WHEN o.bit > 0 THEN 1 ELSE 0 END, m.s + o.iou
  FROM m JOIN opts o ON o.k = m.k AND o.t = m.t AND o.i = m.i + 1 WHERE (m.mask & o.bit) = 0),
best AS (SELECT m.k, m.t, max(m.n) AS n, max(m.s) AS s FROM m JOIN np ON np.k = m.k AND np.n = m.i GROUP BY m.k, m.t),
ex AS (
  SELECT images.k, images.k % 11 <> 0 AS valid, CASE WHEN images.k % 11 = 0 THEN 0 ELSE coalesce(np.n, 0) END AS np, coalesce(nt.n, 0) AS nt
  FROM images LEFT JOIN np ON np.k = images.k LEFT JOIN nt ON nt.k = images.k),
f AS (
  SELECT ex.k, valid, np, nt, steps.t, CASE WHEN valid THEN coalesce(best.n, 0) ELSE 0 END AS tp, CASE WHEN valid THEN coalesce(best.s, 0) ELSE 0 END AS s
  FROM ex CROSS JOIN steps LEFT JOIN best ON best.k = ex.k AND best.t = steps.t),
sc AS (
  SELECT k, valid, np, nt,
    CAST(max(tp) FILTER (WHERE t = 0.5) AS BIGINT) AS tp50, CAST(sum(tp) FILTER (WHERE t > 0) AS BIGINT) AS tp_sum,
    avg(CASE WHEN NOT valid THEN 0.0 WHEN np + nt = 0 THEN 1.0 ELSE 2.0 * tp / (np + nt) END) FILTER (WHERE t > 0) AS f1,
    max(CASE WHEN NOT valid THEN 0.0 WHEN np + nt = 0 THEN 1.0 WHEN np = 0 OR nt = 0 THEN 0.0 ELSE 2.0 * s / (np + nt) END) FILTER (WHERE t < 0) AS soft
  FROM f GROUP BY k, valid, np, nt)
"""


def scored(spark, sf_dir):
    return scoring.score(examples(spark, sf_dir))


@query(_MATCH + "SELECT CAST(k AS VARCHAR) AS id, tp50, tp_sum FROM sc")
def match_counts(spark, sf_dir):
    tp_sum = F.aggregate("tp", F.lit(0), lambda s, x: s + x)
    return scored(spark, sf_dir).select("id", F.get("tp", F.lit(0)).cast("long").alias("tp50"), tp_sum.cast("long").alias("tp_sum"))


@query(_MATCH + "SELECT CAST(k AS VARCHAR) AS id, round(soft, 9) AS soft_set_f1 FROM sc")
def soft_f1(spark, sf_dir):
    return scored(spark, sf_dir).select("id", F.round("soft_set_f1", 9).alias("soft_set_f1"))


@query(_MATCH + """SELECT CAST(k AS VARCHAR) AS id, valid AS format_valid, CAST(np AS INTEGER) AS n_predicted, round(f1, 9) AS mean_set_f1, CASE WHEN nt = 0 THEN 'empty' WHEN nt = 1 THEN 'one' ELSE 'multi' END AS count_slice FROM sc""")
def score_rows(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "format_valid", F.size("prediction").alias("n_predicted"), F.round(scoring.mean_f1(F.col("set_f1")), 9).alias("mean_set_f1"), "count_slice")


@query(_MATCH + "SELECT CAST(k AS VARCHAR) AS id, round(CASE WHEN valid THEN 0.10 + 0.90 * soft ELSE 0.0 END, 9) AS reward FROM sc")
def reward(spark, sf_dir):
    return scoring.rewards(examples(spark, sf_dir).select("id", "raw_completion", "targets")).select("id", F.round("reward", 9).alias("reward"))


@query(_MATCH + """SELECT CAST(k AS VARCHAR) AS id, CAST(2 AS BIGINT) AS n, abs(1.0 - r) > 1e-8 AS nonzero_advantage FROM (SELECT k, CASE WHEN valid THEN 0.10 + 0.90 * soft ELSE 0.0 END AS r FROM sc)""")
def reward_spread(spark, sf_dir):
    """Two completions an order: its own, and the truth itself."""
    rows = examples(spark, sf_dir).select("id", "raw_completion", "targets")
    exact = rows.withColumn("raw_completion", _completion("targets"))
    return scoring.uneven_rewards(scoring.rewards(rows.unionByName(exact))).select("id", "n", "nonzero_advantage")


_SUMMARY = """
  count(*) AS examples, count_if(nt > 0) AS positive_examples, count_if(nt = 0) AS negative_examples,
  round(avg(f1) FILTER (WHERE nt > 0), 9) AS positive_macro_mean_set_f1_50_95, round(avg(f1), 9) AS all_macro_mean_set_f1_50_95,
  CAST(coalesce(sum(tp50), 0) AS BIGINT) AS true_positives, CAST(coalesce(sum(np - tp50), 0) AS BIGINT) AS false_positives, CAST(coalesce(sum(nt - tp50), 0) AS BIGINT) AS false_negatives,
  round(avg(soft) FILTER (WHERE nt > 0), 9) AS positive_macro_soft_set_f1, round(avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END), 9) AS strict_valid_rate,
  round(avg(CASE WHEN valid AND np = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE nt = 0), 9) AS correct_empty_rate, round(avg(np) FILTER (WHERE nt = 0), 9) AS negative_false_positive_boxes_per_image
"""
_RATES = """
  round(CASE WHEN true_positives + false_positives > 0 THEN true_positives / (true_positives + false_positives)::DOUBLE WHEN false_negatives = 0 THEN 1.0 ELSE 0.0 END, 9) AS precision,
  round(CASE WHEN true_positives + false_negatives > 0 THEN true_positives / (true_positives + false_negatives)::DOUBLE WHEN false_positives = 0 THEN 1.0 ELSE 0.0 END, 9) AS recall,
  round(CASE WHEN 2 * true_positives + false_positives + false_negatives > 0 THEN 2 * true_positives / (2 * true_positives + false_positives + false_negatives)::DOUBLE ELSE 1.0 END, 9) AS f1
"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(_MATCH + f"SELECT *, {_RATES} FROM (SELECT {_SUMMARY} FROM sc)")
def eval_summary(spark, sf_dir):
    return _rounded(report.summarize(scored(spark, sf_dir)))


@query(_MATCH + f""", area AS (
  SELECT k, CASE WHEN a < 0.01 THEN 'small' WHEN a < 0.10 THEN 'medium' ELSE 'large' END AS area FROM (SELECT k, avg((x2 - x1) * (y2 - y1) / 1000000.0::DOUBLE) AS a FROM truth GROUP BY k)),
v AS (
  SELECT sc.*, u.slice, u.value FROM sc LEFT JOIN area ON area.k = sc.k, LATERAL (VALUES ('overall', 'all'), ('count', CASE WHEN nt = 0 THEN 'empty' WHEN nt = 1 THEN 'one' ELSE 'multi' END), ('area', area.area), ('concept', 'c' || CAST(sc.k % 3 AS VARCHAR))) u(slice, value)
  WHERE u.value IS NOT NULL),
fixed AS (SELECT * FROM (VALUES ('overall', 'all'), ('count', 'empty'), ('count', 'one'), ('count', 'multi'), ('area', 'small'), ('area', 'medium'), ('area', 'large')) x(slice, value)
  UNION SELECT 'concept', 'c' || CAST(k % 3 AS VARCHAR) FROM sc),
agg AS (SELECT slice, value, {_SUMMARY} FROM v GROUP BY slice, value),
filled AS (SELECT fixed.slice, fixed.value, coalesce(examples, 0) AS examples, coalesce(positive_examples, 0) AS positive_examples, coalesce(negative_examples, 0) AS negative_examples,
  positive_macro_mean_set_f1_50_95, all_macro_mean_set_f1_50_95, coalesce(true_positives, 0) AS true_positives, coalesce(false_positives, 0) AS false_positives, coalesce(false_negatives, 0) AS false_negatives,
  positive_macro_soft_set_f1, strict_valid_rate, correct_empty_rate, negative_false_positive_boxes_per_image FROM fixed LEFT JOIN agg ON agg.slice = fixed.slice AND agg.value = fixed.value)
SELECT *, {_RATES} FROM filled""")
def eval_slices(spark, sf_dir):
    return _rounded(report.slices(scored(spark, sf_dir)))


@query(_MATCH + """, said AS (SELECT k, list_sort(list([x1, y1, x2, y2])) AS boxes FROM preds GROUP BY k), true_ AS (SELECT k, list_sort(list([x1, y1, x2, y2])) AS boxes FROM truth GROUP BY k),
pairs AS (SELECT sc.k, valid, np, nt, f1, said.boxes IS NOT DISTINCT FROM true_.boxes AS same FROM sc LEFT JOIN said ON said.k = sc.k LEFT JOIN true_ ON true_.k = sc.k)
SELECT count(*) > 0 AS applicable, count(*) AS groups, count(*) AS pairs, round(avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END), 9) AS strict_valid_pair_rate,
  round(avg(CASE WHEN valid AND same THEN 1.0 ELSE 0.0 END), 9) AS exact_detection_set_rate, round(avg(CASE WHEN valid THEN f1 ELSE 0.0 END), 9) AS pairwise_macro_mean_set_f1_50_95 FROM pairs""")
def reference_swap(spark, sf_dir):
    """Each order under two references: one with its completion, one with the truth as the completion."""
    sides = F.array(F.struct("id", "reference_key", "raw_completion"), F.struct(F.concat("id", F.lit("b")).alias("id"), F.lit("r1").alias("reference_key"), _completion("targets").alias("raw_completion")))
    shared = ["visual_concept", "query", "target_key", "targets", "pixel_boxes", "width", "height"]
    rows = examples(spark, sf_dir).select(*shared, F.inline(sides))
    return _rounded(report.reference_swap(scoring.score(rows)))


# ---------------------------------------------------------------- hashes, schedules, shards

@query("SELECT doc_id, sha256(concat_ws(chr(31), '17', CAST(doc_id AS VARCHAR), lang, CASE WHEN n_chars > 1500 THEN 'True' ELSE 'False' END)) AS h FROM documents")
def stable_hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", stable_hash(SEED, F.col("doc_id"), F.col("lang"), F.when(F.col("n_chars") > 1500, "True").otherwise("False")).alias("h"))


def kinds(spark, sf_dir):
    """Schedule rows: documents by id, positive unless the id is divisible by 4."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4 != 0).alias("positive"))


@query("""WITH r AS (SELECT doc_id AS id, doc_id % 4 <> 0 AS positive, row_number() OVER (PARTITION BY doc_id % 4 <> 0 ORDER BY sha256('17:' || CASE WHEN doc_id % 4 <> 0 THEN 'positive' ELSE 'negative' END || ':' || CAST(doc_id AS VARCHAR))) AS i FROM documents)
SELECT id, positive, row_number() OVER (ORDER BY i, CASE WHEN positive THEN 0 ELSE 1 END) - 1 AS position FROM r""")
def order_interleave(spark, sf_dir):
    return schedule.interleave(kinds(spark, sf_dir), SEED)


def _ratio_sql(epoch: str) -> str:
    return f"""r AS (SELECT {epoch} AS epoch, doc_id AS id, doc_id % 4 <> 0 AS positive, row_number() OVER (PARTITION BY {epoch}, doc_id % 4 <> 0 ORDER BY sha256('17:' || CAST({epoch} AS VARCHAR) || ':' || CASE WHEN doc_id % 4 <> 0 THEN 'p' ELSE 'n' END || ':' || CAST(doc_id AS VARCHAR))) - 1 AS i FROM documents, (SELECT unnest([0, 1, 2]) AS e)),
c AS (SELECT count_if(doc_id % 4 <> 0) AS p, count_if(doc_id % 4 = 0) AS n, count(*) AS total FROM documents),
o AS (SELECT r.*, total, row_number() OVER (PARTITION BY epoch ORDER BY CASE WHEN positive THEN least(i // greatest(1, p // n), n) ELSE i END, CASE WHEN positive THEN 0 ELSE 1 END, i) - 1 AS place FROM r, c)"""


@query(f"WITH {_ratio_sql('e')} SELECT id, positive, place, CAST(epoch AS INTEGER) AS epoch FROM o WHERE epoch = 0")
def order_ratio(spark, sf_dir):
    return schedule.ratio_epoch(kinds(spark, sf_dir), SEED, 0)


@query(f"WITH {_ratio_sql('e')} SELECT id, positive, place, CAST(epoch AS INTEGER) AS epoch, epoch * total + place AS position FROM o WHERE epoch < 2 OR place < ceil(total * 0.5)")
def epoch_schedule(spark, sf_dir):
    return schedule.epochs(kinds(spark, sf_dir), 2.5, SEED)


@query("""WITH f AS (SELECT doc_id AS id, doc_id % 4 <> 0 AS positive, doc_id AS position, min(doc_id) OVER (PARTITION BY doc_id % 4 <> 0) AS first FROM documents)
SELECT * FROM (SELECT id, positive, position, row_number() OVER (ORDER BY CASE WHEN id = first AND positive THEN 0 WHEN id = first THEN 1 ELSE 2 END, position) - 1 AS place FROM f) WHERE place < 50""")
def front_load(spark, sf_dir):
    return schedule.front_load(kinds(spark, sf_dir).withColumn("position", F.col("id")), 50)


@query("SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) % 7 AS INTEGER) AS shard, row_number() OVER (ORDER BY id) - 1 AS rank FROM (SELECT doc_id AS id FROM documents)")
def stride_shard(spark, sf_dir):
    return schedule.stride_shard(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), 7)


@query("""WITH r AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS rank, count(*) OVER () AS n FROM documents), s AS (SELECT id, CAST(rank % 7 AS INTEGER) AS shard, rank // 7 AS slot, n FROM r)
SELECT id, shard, slot, false AS padded FROM s UNION ALL SELECT id, shard, (n + 6) // 7 - 1, true FROM s WHERE slot = 0 AND ((n + 6) // 7 - 1) * 7 + shard >= n""")
def pad_shard(spark, sf_dir):
    return schedule.padded_shards(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), 7).drop("rank")


@query("SELECT doc_id AS id FROM documents WHERE n_chars // 4 > 1536")
def length_excluded(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("n_chars") / 4).alias("tokens"))
    return schedule.within_length(rows, "tokens", 1536)[1]


# ---------------------------------------------------------------- checks and sets

@query("""SELECT coalesce(o_orderkey, k) AS k, CASE WHEN k IS NULL THEN 'missing' ELSE 'extra' END AS side
FROM orders FULL OUTER JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) ON o_orderkey = k WHERE o_orderkey IS NULL OR k IS NULL""")
def coverage_check(spark, sf_dir):
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return checks.coverage(expected, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct(), "k")


@query("SELECT o_orderkey AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphans(spark, sf_dir):
    return checks.orphans(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


@query("SELECT group_id, list_sort(list(DISTINCT split)) AS splits FROM (SELECT source AS group_id, CASE WHEN doc_id % 97 = 0 THEN 'test' ELSE 'train' END AS split FROM documents) GROUP BY group_id HAVING count(DISTINCT split) > 1")
def leakage_check(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("group_id"), F.when(F.col("doc_id") % 97 == 0, "test").otherwise("train").alias("split"))
    return checks.leaking_groups(rows)


@query("""WITH a AS (SELECT DISTINCT lang AS v FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT lang AS v FROM documents WHERE n_chars > 20000)
SELECT 'union' AS op, v FROM (SELECT v FROM a UNION SELECT v FROM b) UNION ALL SELECT 'except', v FROM (SELECT v FROM a EXCEPT SELECT v FROM b) UNION ALL SELECT 'intersect', v FROM (SELECT v FROM a INTERSECT SELECT v FROM b)""")
def set_ops(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a, b = d.where("doc_id % 2 = 0").select(F.col("lang").alias("v")), d.where("n_chars > 20000").select(F.col("lang").alias("v"))
    parts = {"union": a.union(b).distinct(), "except": a.subtract(b), "intersect": a.intersect(b)}
    out = None
    for op, part in parts.items():
        part = part.select(F.lit(op).alias("op"), "v")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT doc_id, list_filter(['empty_text', 'long', 'other_source'], lambda x: (x = 'empty_text' AND n_chars < 40) OR (x = 'long' AND n_chars > 10000) OR (x = 'other_source' AND source <> 'src0')) AS broken FROM documents""")
def row_violations(spark, sf_dir):
    rules = checks.violations(empty_text=F.col("n_chars") < 40, long=F.col("n_chars") > 10000, other_source=F.col("source") != "src0")
    return table(spark, sf_dir, "documents").select("doc_id", rules.alias("broken"))


@query("SELECT l_orderkey AS k, l_linenumber AS ln, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.struct(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln")).alias("key"))
    return checks.repeated(rows, "key").select("key.k", "key.ln", "n")


# ---------------------------------------------------------------- groups, splits, pairs

_KEYS = "d AS (SELECT doc_id, lang, source, n_chars, sha256(text) AS h, source || ':' || CAST(n_chars AS VARCHAR) AS g FROM documents)"
_GROUPS = f"""WITH RECURSIVE {_KEYS},
e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY h) AS b FROM d UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY g) FROM d),
links AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS component FROM reach GROUP BY a),
named AS (SELECT component, substr(sha256(string_agg(CAST(doc_id AS VARCHAR), chr(31) ORDER BY doc_id)), 1, 24) AS group_id, count(*) AS members FROM comp GROUP BY component)
"""


def groups(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.concat_ws(":", "source", F.col("n_chars").cast("string")).alias("g"))
    return grouping.leakage_groups(rows, "doc_id", ["h", "g"])


@query(_GROUPS + "SELECT doc_id, component, group_id, members FROM comp JOIN named USING (component)")
def leakage_groups(spark, sf_dir):
    return groups(spark, sf_dir)


@query("""SELECT doc_id, source || CASE doc_id % 3 WHEN 0 THEN ':name:scene' || doc_id WHEN 1 THEN ':sequence:k1:x:y' ELSE ':name:b' || doc_id END AS group_key FROM documents""")
def canonical_names(spark, sf_dir):
    """Group keys of names with variants. NFKC is beyond SQL, which says the keys by the names' construction."""
    stems = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("GXcam_scene"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("a_K1_x_y_01-C"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("ｂ"), F.col("doc_id").cast("string"), F.lit("_artificial_scene_aug2")))
    return table(spark, sf_dir, "documents").select("doc_id", group_key(F.col("source"), stems).alias("group_key"))


def placed_images(spark, sf_dir):
    """Documents as images: their language is a concept, and every fourth also has the next one; splits by group hash."""
    by = groups(spark, sf_dir).select("doc_id", "group_id")
    d = table(spark, sf_dir, "documents").join(by, "doc_id")
    also = F.when(F.col("doc_id") % 4 == 0, F.when(F.col("lang") == "de", "en").otherwise("de"))
    split = F.when(F.substring("group_id", 1, 1).isin("0", "1"), "test").otherwise("train")
    return d.select(F.col("doc_id").alias("record_id"), "group_id", split.alias("split"), F.array_sort(F.array_distinct(F.array_compact(F.array("lang", also)))).alias("concepts"))


_PLACED = _GROUPS + """, img AS (
  SELECT d.doc_id AS record_id, named.group_id, CASE WHEN substr(named.group_id, 1, 1) IN ('0', '1') THEN 'test' ELSE 'train' END AS split,
    list_distinct(list_filter([lang, CASE WHEN d.doc_id % 4 = 0 THEN CASE WHEN lang = 'de' THEN 'en' ELSE 'de' END END], lambda x: x IS NOT NULL)) AS concepts
  FROM d JOIN comp USING (doc_id) JOIN named USING (component)),
has AS (SELECT record_id, group_id, split, unnest(concepts) AS concept FROM img),
absent AS (
  SELECT record_id, group_id, split, concept, row_number() OVER (PARTITION BY record_id ORDER BY sha256(concat_ws(chr(31), '17', split, CAST(record_id AS VARCHAR), 'negative', concept))) AS n
  FROM img, (SELECT unnest(['de', 'en', 'es', 'fr']) AS concept) WHERE NOT list_contains(concepts, concept)),
wanted AS (SELECT record_id, group_id, split, concept, true AS positive FROM has UNION ALL SELECT record_id, group_id, split, concept, false FROM absent WHERE n <= 1)
"""
CLASSES = ["de", "en", "es", "fr"]


@query(_PLACED + "SELECT record_id, split, concept FROM absent WHERE n <= 1")
def negative_sampling(spark, sf_dir):
    return pairing.negatives(placed_images(spark, sf_dir), CLASSES, 1, SEED)


@query(_PLACED + ", top AS (SELECT record_id, split, concept FROM absent WHERE n <= 2) SELECT * FROM top")
def negative_window(spark, sf_dir):
    images = placed_images(spark, sf_dir)
    offered = images.select("record_id", "split", F.explode(F.array_except(F.array(*[F.lit(c) for c in CLASSES]), "concepts")).alias("concept"))
    return pairing.top_absent_window(offered, SEED, 2)


@query(_PLACED + """SELECT w.record_id, w.group_id, w.split, w.concept, w.positive, arg_min(h.record_id, sha256(concat_ws(chr(31), '17', CAST(w.record_id AS VARCHAR), w.concept, CAST(h.record_id AS VARCHAR)))) AS reference_id
FROM wanted w JOIN has h ON w.split = h.split AND w.concept = h.concept AND w.group_id <> h.group_id GROUP BY ALL""")
def reference_pairing(spark, sf_dir):
    images = write_table(placed_images(spark, sf_dir), "placed")
    return pairing.references(pairing.requests(images, CLASSES, 1, SEED), images, SEED)


@query(_PLACED + """, spots AS (SELECT *, sha256(concat_ws(chr(31), '17', CAST(record_id AS VARCHAR), concept)) AS place FROM wanted),
ring AS (SELECT *, sha256(concat_ws(chr(31), '17', concept, CAST(record_id AS VARCHAR))) AS place FROM has)
SELECT w.record_id, w.group_id, w.split, w.concept, w.positive, arg_min(h.record_id, CASE WHEN h.place >= w.place THEN '0' ELSE '1' END || h.place) AS reference_id
FROM spots w JOIN ring h ON w.split = h.split AND w.concept = h.concept AND w.group_id <> h.group_id GROUP BY ALL""")
def ring_pairing(spark, sf_dir):
    images = write_table(placed_images(spark, sf_dir), "placed")
    return pairing.ring_references(pairing.requests(images, CLASSES, 1, SEED), images, SEED, arc=256)


@query(_PLACED + f""", refs AS (SELECT w.*, arg_min(h.record_id, sha256(concat_ws(chr(31), '17', CAST(w.record_id AS VARCHAR), w.concept, CAST(h.record_id AS VARCHAR)))) AS ref
  FROM wanted w JOIN has h ON w.split = h.split AND w.concept = h.concept AND w.group_id <> h.group_id GROUP BY w.record_id, w.group_id, w.split, w.concept, w.positive)
SELECT substr(sha256(concat_ws(chr(31), '{pairing.RECORD_DOMAIN}', split, CAST(record_id AS VARCHAR), concept, CAST(ref AS VARCHAR), CASE WHEN positive THEN 'True' ELSE 'False' END)), 1, 24) AS id,
  concept AS visual_concept, positive, CAST(record_id AS VARCHAR) AS target_path, CAST(ref AS VARCHAR) AS reference_path, CAST(CASE WHEN positive THEN 1 ELSE 0 END AS INTEGER) AS n_boxes FROM refs""")
def dataset_records(spark, sf_dir):
    images = placed_images(spark, sf_dir)
    objects = F.transform("concepts", lambda c: F.struct(c.alias("concept"), F.array(F.lit(1), F.lit(1), F.lit(50), F.lit(60)).alias("box")))
    full = write_table(images.select("*", F.lit("docs").alias("source"), F.col("record_id").cast("string").alias("path"), F.lit(100).alias("width"), F.lit(100).alias("height"), objects.alias("objects")), "full")
    rows = pairing.records(pairing.references(pairing.requests(full, CLASSES, 1, SEED), full, SEED), full)
    return rows.select("id", "visual_concept", "positive", F.col("target.path").alias("target_path"), F.col("reference.path").alias("reference_path"), F.size("detection_set").alias("n_boxes"))


@query(_PLACED + """SELECT 'concept' AS kind, concept AS name, count(*) AS n FROM has GROUP BY concept
UNION ALL SELECT 'instances', concept, 2 * count(*) FROM has GROUP BY concept
UNION ALL SELECT 'images', s.split, count(img.record_id) FROM (VALUES ('train'), ('validation'), ('test')) s(split) LEFT JOIN img ON img.split = s.split GROUP BY s.split
UNION ALL SELECT 'groups', s.split, count(DISTINCT img.group_id) FROM (VALUES ('train'), ('validation'), ('test')) s(split) LEFT JOIN img ON img.split = s.split GROUP BY s.split
UNION ALL SELECT 'duplicates', 'groups', count(*) FROM named WHERE members > 1""")
def audit_counts(spark, sf_dir):
    images = placed_images(spark, sf_dir)
    objects = F.transform("concepts", lambda c: F.struct(c.alias("concept"), F.array(F.lit(1), F.lit(1), F.lit(5), F.lit(6)).alias("box")))
    counts = pairing.audit(write_table(images.withColumn("objects", F.concat(objects, objects)), "audit"))
    rows = counts["class_images"].select(F.lit("concept").alias("kind"), F.col("concept").alias("name"), "n")
    rows = rows.unionByName(counts["class_instances"].select(F.lit("instances").alias("kind"), F.col("concept").alias("name"), "n"))
    for column in ("images", "groups"):
        rows = rows.unionByName(counts["splits"].select(F.lit(column).alias("kind"), F.col("split").alias("name"), F.col(column).alias("n")))
    return rows.unionByName(counts["duplicate_groups"].select(F.lit("duplicates").alias("kind"), F.lit("groups").alias("name"), "n"))


_SPLITS = _PLACED + """, grp AS (SELECT group_id, list_distinct(flatten(list(concepts))) AS concepts FROM img GROUP BY group_id),
ph AS (SELECT p, 1 + p // 3 AS least, p % 3 AS sp, ['train', 'validation', 'test'][p % 3 + 1] AS split FROM range(6) r(p)),
want AS (SELECT [total - v - t, v, t] AS n FROM (SELECT count(*) AS total, CAST(round_even(count(*) * 0.1, 0) AS BIGINT) AS v, CAST(round_even(count(*) * 0.1, 0) AS BIGINT) AS t FROM grp)),
pick AS (
  SELECT CAST(0 AS BIGINT) AS p, list_transform(range(12), lambda x: CAST(0 AS BIGINT)) AS held, CAST([] AS VARCHAR[]) AS taken, CAST([] AS VARCHAR[]) AS splits
  UNION ALL
  SELECT p + CASE WHEN best IS NULL THEN 1 ELSE 0 END,
    list_transform(held, lambda x, i: x + CASE WHEN best IS NOT NULL AND (i - 1) // 4 = sp AND list_contains(best.concepts, ['de', 'en', 'es', 'fr'][(i - 1) % 4 + 1]) THEN 1 ELSE 0 END),
    CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best.group_id) END, CASE WHEN best IS NULL THEN splits ELSE list_append(splits, split) END
  FROM (
    SELECT p, held, taken, splits, sp, split,
      arg_min({'group_id': group_id, 'concepts': concepts}, CAST(9 - n AS VARCHAR) || sha256(concat_ws(chr(31), '17', CAST(least AS VARCHAR), split, group_id))) FILTER (WHERE n > 0 AND NOT list_contains(taken, group_id)) AS best
    FROM (
      SELECT pick.*, ph.least, ph.sp, ph.split, grp.group_id, grp.concepts,
        len(list_filter(grp.concepts, lambda c: held[ph.sp * 4 + list_position(['de', 'en', 'es', 'fr'], c)] < ph.least)) AS n
      FROM pick JOIN ph ON ph.p = pick.p CROSS JOIN grp)
    GROUP BY p, held, taken, splits, sp, split)),
first AS (SELECT unnest(taken) AS group_id, unnest(splits) AS split FROM pick WHERE p = 6),
have AS (SELECT [count(*) FILTER (split = 'train'), count(*) FILTER (split = 'validation'), count(*) FILTER (split = 'test')] AS m FROM first),
rest AS (
  SELECT group_id, row_number() OVER (ORDER BY sha256(concat_ws(chr(31), '17', 'remaining', group_id))) AS i,
    list_transform(['train', 'validation', 'test'], lambda s: sha256(concat_ws(chr(31), '17', group_id, s))) AS keys
  FROM grp WHERE group_id NOT IN (SELECT group_id FROM first)),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS group_id, CAST(0 AS BIGINT) AS sp, list_transform(n, lambda x, k: x - m[k]) AS lack FROM want, have
  UNION ALL
  SELECT i, group_id, sp, list_transform(lack, lambda x, k: x - CASE WHEN k = sp THEN 1 ELSE 0 END)
  FROM (SELECT r.i, r.group_id, lack, list_sort(list_transform([1, 2, 3], lambda k: {'lack': -lack[k], 'key': r.keys[k], 'sp': CAST(k AS BIGINT)}))[1].sp AS sp FROM walk JOIN rest r ON r.i = walk.i + 1))
SELECT group_id, split FROM first UNION ALL SELECT group_id, ['train', 'validation', 'test'][sp] FROM walk WHERE group_id IS NOT NULL
"""


@query(_SPLITS)
def split_assignment(spark, sf_dir):
    """Greedy: the SQL walks through the groups one by one."""
    by = placed_images(spark, sf_dir).select("group_id", F.explode("concepts").alias("c")).groupBy("group_id").agg(F.collect_set("c").alias("concepts"))
    return splits.assign_splits(write_table(by, "by_group"), CLASSES, {"train": 0.8, "validation": 0.1, "test": 0.1}, SEED)


@query("SELECT positive, id FROM (SELECT doc_id % 4 <> 0 AS positive, CAST(min(doc_id) AS BIGINT) AS id FROM documents GROUP BY 1)")
def first_of_kind(spark, sf_dir):
    return pairing.first_of_each_kind(kinds(spark, sf_dir)).select("positive", "id")


# ---------------------------------------------------------------- sources, gates, seams

@query(f"WITH {LINES} SELECT k, count(*) AS n_objects, CAST(sum(x1) AS BIGINT) AS sum_x1, min(flag) AS first_concept FROM truth GROUP BY k")
def xml_objects(spark, sf_dir):
    """Annotations written as XML text and parsed again."""

    def tag(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))

    box = F.concat(tag("xmin", F.col("x1") + 1), tag("ymin", F.col("y1") + 1), tag("xmax", F.col("x2")), tag("ymax", F.col("y2")))
    item = F.concat(F.lit("<object>"), tag("name", F.col("flag")), F.lit("<bndbox>"), box, F.lit("</bndbox></object>"))
    notes = lines(spark, sf_dir).groupBy("k").agg(F.concat(F.lit("<annotation><size><width>1000</width><height>1000</height></size>"), F.array_join(F.collect_list(item), ""), F.lit("</annotation>")).alias("xml"))
    found = notes.select("k", voc.objects(voc.parsed(F.col("xml")), True, F.lit(1000), F.lit(1000)).alias("o"))
    total = F.aggregate("o", F.lit(0).cast("long"), lambda s, x: s + F.get(x["box"], F.lit(0)))
    return found.select("k", F.size("o").cast("long").alias("n_objects"), total.alias("sum_x1"), F.get("o", F.lit(0))["concept"].alias("first_concept"))


@query(r"SELECT event_id, coalesce(nullif(trim(regexp_replace(event_type || '/' || CAST(event_id AS VARCHAR) || ' ..', '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'task') AS name FROM events")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", safe_name(F.concat("event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(" .."))).alias("name"))


@query("""WITH w AS (SELECT * FROM (VALUES ('C0', true), ('C1', true), ('C2', true), ('H1', true), ('H2', true), ('D1', false)) x(gate, mandatory)),
s AS (SELECT CASE n_regionkey WHEN 0 THEN 'C0' WHEN 1 THEN 'C1' WHEN 2 THEN 'C2' ELSE 'H1' END AS gate, bool_and(n_nationkey <> 3) AS passed FROM nation GROUP BY 1)
SELECT w.gate, mandatory, CASE WHEN passed IS NULL THEN 'skipped' WHEN passed THEN 'pass' ELSE 'fail' END AS status FROM w LEFT JOIN s ON w.gate = s.gate""")
def gate_report(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    name = F.when(F.col("n_regionkey") == 0, "C0").when(F.col("n_regionkey") == 1, "C1").when(F.col("n_regionkey") == 2, "C2").otherwise("H1")
    return gates.gate_report(gates.expected(spark, "release"), nation.select(name.alias("gate"), (F.col("n_nationkey") != 3).alias("passed")))


@query("SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, trim(text) AS content FROM conversations")
def completion_texts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    half = F.floor(F.length("text") / 2).cast("int")
    blocks = F.array(
        F.struct(F.lit("text").alias("type"), F.substring(F.col("text"), F.lit(1), half).alias("text")), F.struct(F.lit("image").alias("type"), F.lit("none").alias("text")),
        F.struct(F.lit("text").alias("type"), F.substring(F.col("text"), half + 1, F.length("text")).alias("text")),
    )
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), scoring.completion_text(blocks).alias("content"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 10 = 0 THEN 'skipped' WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS status FROM documents")
def batch_status(spark, sf_dir):
    """The batch runner with a model that fails on some rows, and some results already there."""
    d = table(spark, sf_dir, "documents")
    tasks = d.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("ordinal"), safe_name(F.col("doc_id").cast("string")).alias("output_name"))
    done = d.where("doc_id % 10 = 0").select(F.col("doc_id").cast("string").alias("output_name"))

    def factory():
        def model(request, budget):
            if request["ordinal"] % 7 == 0:
                raise ValueError("seven")
            return "[]"

        return model

    return predict.batch(tasks, factory, done).select("id", "status")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, '[]' AS raw_completion FROM documents")
def prediction_round_trip(spark, sf_dir):
    """Predictions from the model seam, written as JSON lines and scanned strictly."""
    made = predict.predict(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id")), predict.fixed("[]"))
    path = new_path(spark, "predictions")
    made.write.json(path)
    return files.predictions(spark, path)


# ---------------------------------------------------------------- means, coverage, runs, sizes

@query("""SELECT l_returnflag AS flag, round(avg(l_extendedprice / 7), 6) AS mean_price, round(avg(CASE WHEN l_linenumber > 3 THEN l_discount END), 9) AS mean_discount FROM lineitem GROUP BY 1""")
def exact_mean(spark, sf_dir):
    """Means that are the same bits under any partitions; rounded here, as SQL adds in some order."""
    rows = table(spark, sf_dir, "lineitem").withColumn("flag", F.col("l_returnflag"))
    means = exact_means(rows, ["flag"], {"mean_price": F.col("l_extendedprice") / 7, "mean_discount": F.when(F.col("l_linenumber") > 3, F.col("l_discount"))})
    return means.select("flag", F.round("mean_price", 6).alias("mean_price"), F.round("mean_discount", 9).alias("mean_discount"))


@query(_MATCH + """, v AS (
  SELECT sc.*, u.slice, u.value FROM sc, LATERAL (VALUES ('overall', 'all'), ('concept', 'c' || CAST(sc.k % 3 AS VARCHAR))) u(slice, value))
SELECT slice, value, count(*) AS examples, round(avg(f1), 9) AS all_macro_mean_set_f1_50_95, round(avg(soft) FILTER (WHERE nt > 0), 9) AS positive_macro_soft_set_f1 FROM v GROUP BY slice, value""")
def exact_slices(spark, sf_dir):
    rows = report.exact_slices(write_table(scored(spark, sf_dir), "scored")).where("slice IN ('overall', 'concept')")
    return _rounded(rows.select("slice", "value", "examples", "all_macro_mean_set_f1_50_95", "positive_macro_soft_set_f1"))


@query("""WITH p AS (SELECT doc_id AS p FROM documents WHERE doc_id % 97 > 2 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 89 = 5 AND doc_id % 97 > 2 UNION ALL SELECT -1 - doc_id FROM documents WHERE doc_id < 2),
e AS (SELECT max(doc_id) + 1 AS n FROM documents),
d AS (SELECT DISTINCT p FROM p, e WHERE p BETWEEN 0 AND n - 1 UNION SELECT n FROM e),
g AS (SELECT lag(p, 1, -1) OVER (ORDER BY p) + 1 AS lo, p - 1 AS hi FROM d)
SELECT 'gap' AS kind, lo, hi FROM g WHERE lo <= hi UNION ALL SELECT 'repeat', p, p FROM p GROUP BY p HAVING count(*) > 1 UNION ALL SELECT 'outside', p, p FROM p WHERE p < 0""")
def sampler_coverage(spark, sf_dir):
    """What a sampler that drops some documents, repeats others and makes two up leaves to find."""
    d = table(spark, sf_dir, "documents")
    kept = d.where("doc_id % 97 > 2").select(F.col("doc_id").alias("item"))
    items = kept.unionByName(kept.where("item % 89 = 5")).unionByName(d.where("doc_id < 2").select((-1 - F.col("doc_id")).alias("item")))
    return coverage.sampler_faults(items, 0, d.agg(F.max("doc_id")).first()[0] + 1)


_RUNS = """e AS (
  SELECT CAST(user_id % 40 AS VARCHAR) AS run, event_id % 3 AS k, CASE WHEN user_id % 40 = 3 AND event_id % 2 = 0 THEN 'y' ELSE 'x' END AS identity, event_id % 11 AS step,
    'f' || CAST(CASE WHEN user_id % 5 = 0 THEN event_id % 2 ELSE 0 END AS VARCHAR) AS folder, event_id % 4 <> 0 AS complete, 'i' || CAST(event_id % 13 AS VARCHAR) AS id, event_id % 5 <> 0 AS positive, value AS reward
  FROM events)"""


@query(f"""WITH {_RUNS},
last AS (SELECT run, max(step) AS step FROM e WHERE k = 1 AND complete GROUP BY run),
folders AS (SELECT e.run, count(DISTINCT folder) AS n FROM e JOIN last ON last.run = e.run AND last.step = e.step WHERE k = 1 AND complete GROUP BY e.run),
ids AS (SELECT run, id, max(reward) - min(reward) > 1e-8 AS uneven FROM e WHERE k = 2 GROUP BY run, id),
seen AS (SELECT run, count(DISTINCT identity) FILTER (k = 0) AS identities, count(*) FILTER (k = 2) AS rewards, coalesce(bool_or(positive) FILTER (k = 2), false) AS positive, coalesce(bool_or(NOT positive) FILTER (k = 2), false) AS negative FROM e GROUP BY run)
SELECT seen.run, coalesce(last.step, -1) AS step, CASE WHEN identities > 1 THEN 'refused' WHEN folders.n > 1 THEN 'ambiguous' WHEN last.step IS NULL THEN 'open' ELSE 'ready' END AS status, rewards, positive, negative,
  (SELECT count(*) FROM ids WHERE ids.run = seen.run AND uneven) AS uneven_ids
FROM seen LEFT JOIN last ON last.run = seen.run LEFT JOIN folders ON folders.run = seen.run""")
def run_events(spark, sf_dir):
    e, kind = table(spark, sf_dir, "events"), F.col("event_id") % 3
    known = e.select(
        (F.col("user_id") % 40).cast("string").alias("run"), F.when(kind == 0, "start").when(kind == 1, "checkpoint").otherwise("reward").alias("kind"),
        F.when((F.col("user_id") % 40 == 3) & (F.col("event_id") % 2 == 0), "y").otherwise("x").alias("identity"), (F.col("event_id") % 11).alias("step"),
        F.concat(F.lit("f"), F.when(F.col("user_id") % 5 == 0, F.col("event_id") % 2).otherwise(0).cast("string")).alias("folder"), (F.col("event_id") % 4 != 0).alias("complete"),
        F.concat(F.lit("i"), (F.col("event_id") % 13).cast("string")).alias("id"), (F.col("event_id") % 5 != 0).alias("positive"), F.col("value").alias("reward"),
    )
    return followed.follow(known).drop("identity").fillna(-1, ["step"])


@query("""WITH c AS (SELECT CAST(user_id AS VARCHAR) AS run, user_id * 100000 + event_id AS step FROM events WHERE event_type <> 'error' AND event_id % 2 = 0) SELECT run, max(step) AS step FROM c GROUP BY run""")
def complete_steps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.concat(F.when(F.col("event_id") % 2 == 0, "checkpoint-").otherwise("best-"), F.lpad((F.col("user_id") * 100000 + F.col("event_id")).cast("string"), 12, "0"))
    return runs.complete_steps(e.select(F.col("user_id").cast("string").alias("run"), name.alias("folder"), (F.col("event_type") != "error").alias("complete")))


@query("SELECT count(DISTINCT user_id % 8) AS ranks, max(value) AS peak_gib, bool_or(event_type = 'click') AS seen_positive, coalesce(bool_or(CASE WHEN value > 1e9 THEN true END), false) AS seen_negative FROM events")
def rank_reports(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return runs.over_ranks(e.select((F.col("user_id") % 8).alias("rank"), F.col("value").alias("peak_gib"), (F.col("event_type") == "click").alias("seen_positive"), F.when(F.col("value") > 1e9, True).alias("seen_negative")))


@query("""WITH i AS (SELECT user_id, count(*) AS n, count_if(event_type = 'click') AS p, max(value) - min(value) AS spread FROM events GROUP BY user_id)
SELECT CAST(sum(n) AS BIGINT) AS events, sum(p) > 0 AS positive, sum(n - p) > 0 AS negative, count_if(n >= 2 AND spread > 1e-8) AS uneven_ids FROM i""")
def kinds_seen(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return runs.kinds_seen(e.select(F.col("user_id").alias("id"), (F.col("event_type") == "click").alias("positive"), F.col("value").alias("reward")))


@query("""WITH c AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS records, count_if(doc_id % 4 <> 0) AS positive, count_if(doc_id % 4 = 0) AS negative FROM documents GROUP BY 1)
SELECT s.split, coalesce(records, 0) AS records, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative FROM (VALUES ('train'), ('validation'), ('test')) s(split) LEFT JOIN c ON c.split = s.split""")
def kind_counts(spark, sf_dir):
    return checks.kind_counts(kinds(spark, sf_dir).withColumn("split", F.when(F.col("id") % 10 == 0, "test").otherwise("train")))


_SIZES = """s AS (SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS k,
  CAST(1 + (l_partkey * 37) % 2900 AS DOUBLE) AS w, CAST(1 + (l_suppkey * 53 + l_partkey) % 2700 AS DOUBLE) AS h FROM lineitem),
r AS (SELECT *, CAST(round_even(w / 32, 0) * 32 AS INTEGER) AS nw, CAST(round_even(h / 32, 0) * 32 AS INTEGER) AS nh, sqrt(w * h / 655360.0::DOUBLE) AS shrink, sqrt(65536.0::DOUBLE / (w * h)) AS grow FROM s),
z AS (SELECT k, greatest(w, h) / least(w, h) <= 200 AS fits,
  CASE WHEN nw * nh > 655360 THEN greatest(1, floor(w / shrink / 32)) * 32 WHEN nw * nh < 65536 THEN ceil(w * grow / 32) * 32 ELSE nw END AS width,
  CASE WHEN nw * nh > 655360 THEN greatest(1, floor(h / shrink / 32)) * 32 WHEN nw * nh < 65536 THEN ceil(h * grow / 32) * 32 ELSE nh END AS height FROM r)"""


def sizes(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    w, h = 1 + (F.col("l_partkey") * 37) % 2900, 1 + (F.col("l_suppkey") * 53 + F.col("l_partkey")) % 2700
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 1000 + F.row_number().over(order)).alias("k"), w.cast("int").alias("width"), h.cast("int").alias("height"))


@query(f"WITH {_SIZES} SELECT k, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, CAST(width * height / 1024 AS INTEGER) AS tokens FROM z WHERE fits")
def smart_sizes(spark, sf_dir):
    rows = sizes(spark, sf_dir).withColumn("s", resized(F.col("width"), F.col("height"))).where("s is not null")
    return rows.select("k", F.col("s.width").alias("width"), F.col("s.height").alias("height"), visual_tokens(F.col("s")).alias("tokens"))


@query(f"""WITH {_SIZES}, t AS (SELECT k, CASE WHEN fits THEN CAST(width * height / 1024 AS BIGINT) END AS n, 20 + k % 900 AS q, k % 250 AS a FROM z), u AS (SELECT k, n, q + n + 638 AS prompt, a AS completion FROM t)
SELECT CAST(k AS VARCHAR) AS id, coalesce(prompt, -1) AS prompt_tokens, completion AS completion_tokens, coalesce(prompt + completion, -1) AS total_tokens,
  CASE WHEN n IS NULL OR n NOT BETWEEN 64 AND 640 THEN 'image' WHEN prompt + completion > 1536 THEN 'sequence' WHEN completion NOT BETWEEN 1 AND 192 THEN 'completion' END AS problem FROM u""")
def token_preflight(spark, sf_dir):
    """Sequences of an image beside one of 640 tokens, their texts counted by a seam that counts letters."""

    def factory():
        return lambda query, answer: (len(query), len(query) + len(answer))

    side = F.struct("width", "height")
    full = F.struct(F.lit(640).alias("width"), F.lit(1024).alias("height"))
    letters = lambda n: F.repeat(F.lit("q"), n.cast("int"))
    rows = sizes(spark, sf_dir).select(F.col("k").cast("string").alias("id"), letters(20 + F.col("k") % 900).alias("query"), letters(F.col("k") % 250).alias("answer"), full.alias("reference"), side.alias("target"))
    return preflight(rows, factory).fillna(-1, ["prompt_tokens", "total_tokens"])


@query("""WITH f AS (
  SELECT event_type AS gate, max(value) AS peak, count(DISTINCT user_id) AS world, min(event_id) % 2 = 0 AS clean FROM events GROUP BY 1)
SELECT gate, peak <= 350 AND world >= 150 AND clean AS passed,
  list_sort(list_filter([CASE WHEN peak > 350 THEN 'peak is not at most 350' END, CASE WHEN world < 150 THEN 'world is not at least 150' END, CASE WHEN NOT clean THEN 'said is no detection set' END, CASE WHEN NOT clean THEN 'state is missing' END], lambda x: x IS NOT NULL)) AS faults FROM f""")
def gate_rules(spark, sf_dir):
    """Facts of five gates, one an event type, against rules of four kinds."""
    clean = F.min("event_id") % 2 == 0
    told = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("gate")).agg(
        F.max("value").cast("string").alias("peak"), F.count_distinct("user_id").cast("string").alias("world"), F.when(clean, "[]").otherwise("[").alias("said"), F.when(clean, "done").alias("state")
    )
    facts = told.unpivot("gate", ["peak", "world", "said", "state"], "name", "value")
    rules = [("peak", "at_most", "350"), ("world", "at_least", "150"), ("said", "boxes", ""), ("state", "present", "")]
    listed = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("name", "rule", "bound"), rule, strict=True)]) for rule in rules])
    return gates.judged(told.select("gate", F.inline(listed)), facts)


@query("""SELECT source, '{' || string_agg('"' || lang || '":' || n, ',' ORDER BY lang) || '}' AS by_lang FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source""")
def count_maps(spark, sf_dir):
    """Counts by key, rendered as one map a group."""
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("source").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n"))))).alias("by_lang"))
