"""From annotated images to a published dataset: groups, splits, pairs, records, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.errors import ArtifactError
from boxloom.functions import boxes
from boxloom.functions.schema import RECORD, SPLITS
from boxloom.operators import checks, grouping, pairing, splits
from boxloom.plans import sinks
from boxloom.runtime import write_table
from boxloom.sources import voc
from boxloom.sources.config import CompileConfig, config_hash


def dataset(images: DataFrame, classes: list[str], ratios: dict[str, float], seed: int, per_image: int) -> tuple[DataFrame, DataFrame]:
    """Records of all splits, and the images with their group and split."""
    groups = grouping.leakage_groups(images, "record_id", ["content_sha256", "group_key"]).select("record_id", "group_id")
    grouped = write_table(images.join(groups, "record_id").withColumn("concepts", boxes.concepts(F.col("objects"))), "grouped")
    by_group = grouped.select("group_id", F.explode_outer("concepts").alias("c")).groupBy("group_id").agg(F.collect_set("c").alias("concepts"))
    assigned = write_table(splits.assign_splits(by_group, classes, ratios, seed), "splits")
    placed = write_table(grouped.join(assigned, "group_id"), "placed")
    wanted = pairing.requests(placed, classes, per_image, seed)
    paired = write_table(pairing.references(wanted, placed, seed), "paired")
    lost = checks.orphans(wanted, paired, ["record_id", "concept", "positive"]).limit(5).collect()
    if lost:
        raise checks.DataError(f"no reference from another group for {[(r['record_id'], r['concept']) for r in lost]}")
    return pairing.records(paired, placed), placed


def compile_dataset(spark: SparkSession, config: CompileConfig) -> str:
    """Compile, check and publish; the folder that now holds the dataset."""
    parts = [voc.load(spark, s.name, s.image_dir, s.annotation_dir, config.inclusive) for s in config.sources]
    images, lonely = parts[0]
    for more, others in parts[1:]:
        images, lonely = images.unionByName(more), lonely.unionByName(others)
    images = write_table(images, "images")
    found = images.select(F.explode(boxes.concepts(F.col("objects"))).alias("concept")).distinct()
    checks.require_classes(found, list(config.classes))
    classes = sorted(config.classes) or sorted(r[0] for r in found.collect())
    rows, placed = dataset(images, classes, config.ratios, config.seed, config.negative_per_image)
    rows = write_table(rows, "records")
    checks.require_clean(rows, checks.record_violations(), "id")
    counts = pairing.audit(placed)
    with sinks.publish(spark, config.output) as folder:
        for split in SPLITS:
            sinks.write_lines(rows.where(F.col("split") == split), f"{folder}/{split}")
        audit = {name: [r.asDict() for r in df.orderBy(*df.columns).collect()] for name, df in counts.items()}
        audit["orphan_images"] = lonely.count()
        sinks.write_document(spark, f"{folder}/audit.json", audit)
        hashes = {split: sinks.file_hashes(spark, f"{folder}/{split}") for split in SPLITS}
        sinks.write_document(spark, f"{folder}/manifest.json", {
            "schema_version": 1, "config_hash": config_hash(config), "files": hashes, "sources": {s.name: s.image_dir for s in config.sources},
            "counts": {r["split"]: {k: r[k] for k in ("records", "positive", "negative")} for r in checks.kind_counts(rows).collect()},
        })
    return config.output


def open_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Records by split, after the files are compared with the manifest."""
    manifest = sinks.read_document(spark, f"{folder}/manifest.json")
    if manifest.get("schema_version") != 1:
        raise ArtifactError("unknown schema version")
    for split in SPLITS:
        if sinks.file_hashes(spark, f"{folder}/{split}") != manifest["files"][split]:
            raise ArtifactError(f"files of {split} changed")
    return {split: spark.read.schema(RECORD).option("mode", "FAILFAST").json(f"{folder}/{split}") for split in SPLITS}
