"""Dataset files: annotations, reader labels, manifests, split lists, label text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims

POINTS = "array<struct<x: double, y: double>>"
ANNOTATION = (
    "game string, seq long, "
    f"discard_slots map<string, array<struct<tile: string, face_poly: {POINTS}, riichi: boolean, reliable: boolean, unrendered: boolean, fill: double>>>, "
    f"meld_boxes map<string, array<struct<tile: string, poly: {POINTS}, sideways: boolean, reliable: boolean, fill: double>>>, "
    f"back_boxes map<string, array<struct<tile: string, poly: {POINTS}, reliable: boolean>>>, "
    "hand_boxes array<struct<tile: string, px_box: array<int>, reliable: boolean>>, dora_boxes array<struct<tile: string, px_box: array<int>, reliable: boolean>>, "
    "hud_boxes array<struct<name: string, px_box: array<int>, text: string, reliable: boolean, text_reliable: boolean, flag: string>>, flags array<string>"
)
READER = "file string, name string, text string, pad double"
MANIFEST = "val variant, formats array<string>, games array<struct<name: string, dir: string, kind: string, capture: string, frames_dir: string>>"


def write_annotations(records: DataFrame, path: str, fmt: str = "parquet", compression: str | None = None) -> None:
    """Per-frame annotation records, one folder per game.

    ``compression`` is one of the format's; a text file that is compressed whole (gzip) is read by one task.
    """
    w = records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("game").format(fmt)
    (w.option("compression", compression) if compression else w).save(path)


def read_annotations(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Annotation records; the last one of a (game, seq) counts where a log repeats it."""
    return spark.read.schema(ANNOTATION).format(fmt).load(path)


def write_reader_labels(rows: DataFrame, path: str) -> None:
    """Rows ``game, file, name, text, pad`` as JSON lines, one folder per game."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("game").json(path)


def read_reader_labels(spark: SparkSession, path: str, games: DataFrame) -> DataFrame:
    """Reader labels of the wanted games; games without any are simply absent."""
    d = spark.read.schema(f"{READER}, game string").json(path).withColumn("pad", F.coalesce("pad", F.lit(0.15)))
    return d.join(games.select("game"), "game", "left_semi")


def write_manifest(games: DataFrame, vals: list[str], formats: list[str], path: str) -> None:
    """One JSON document with the holdout, the formats and the games.

    Games are dataset folders, so the document stays small; it is built by one aggregation.
    """
    cols = F.struct("name", "dir", "kind", "capture", "frames_dir")
    doc = games.agg(F.array_sort(F.collect_list(cols)).alias("games")).select(
        F.array(*[F.lit(v) for v in vals]).alias("val"), F.array(*[F.lit(f) for f in formats]).alias("formats"), "games")
    doc.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per game with its holdout flag; ``val`` may be a list or a single name."""
    d = spark.read.schema(MANIFEST).json(path)
    val = F.coalesce(F.try_variant_get("val", "$", "array<string>"), F.array(F.try_variant_get("val", "$", "string")))
    d = d.withColumns({"_val": val, "dataset": F.col("_metadata.file_path")})
    return d.select("dataset", "formats", "_val", F.explode("games").alias("g")).select(
        "dataset", "formats", "g.*", F.array_contains("_val", F.col("g.name")).alias("is_val"))


def write_label_text(files: DataFrame, path: str) -> None:
    """Label texts, one row per frame, one folder per game."""
    files.withColumnRenamed("text", "value").select("game", "value").write.partitionBy("game").text(path)


def write_split_lists(rows: DataFrame, path: str) -> None:
    """Image lists per split in path order, as text in one folder per split."""
    rows.select("split", F.col("path").alias("value")).repartitionByRange("split", "value").sortWithinPartitions("split", "value") \
        .write.partitionBy("split").text(path)


def read_split_lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "").select("split", F.col("value").alias("path"))


def class_file_text(root: str, train: str = "train.txt", val: str = "val.txt") -> str:
    """Class-name file of a split."""
    head = [f"path: {root}", f"train: {train}", f"val: {val}", f"nc: {len(dims.CLASSES)}", "names:"]
    return "\n".join(head + [f"  {i}: '{n}'" for i, n in enumerate(dims.CLASSES)]) + "\n"
