"""Tabular, JSON and text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

STATS_SCHEMA = "path string, mean double, std double"


def read_table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema (image statistics, labels, areas)."""
    return spark.read.csv(path, header=True, schema=schema)


def parse_label_vectors(files: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """``<patch_id>_labels.csv`` contents as ``(patch_id, labels array<double>)``."""
    numbers = F.filter(F.split(F.trim(value), r"[\s,]+"), lambda s: s != "")
    return files.select(
        F.regexp_extract(name, r"([^/]*)_labels\.csv$", 1).alias("patch_id"),
        F.transform(numbers, lambda s: s.cast("double")).alias("labels"),
    )


def read_label_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Headerless label vectors, one small file per patch.

    Millions of tiny files are packed into few tasks by the file size settings;
    convert them once to a table for repeated use.
    """
    files = spark.read.text(f"{folder}/*_labels.csv", wholetext=True).select(
        F.col("_metadata.file_name").alias("name"), "value"
    )
    return parse_label_vectors(files)


def read_class_codes(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects ``{symbol: code}`` as rows ``(source, symbol, code)``."""
    text = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), F.from_json("value", "map<string,int>").alias("m")
    )
    return text.select("source", F.explode("m").alias("symbol", "code"))


RUN_SCHEMA = (
    "NAME string, DIRECTORY string, PATCHES map<string,string>,"
    " MODALITIES struct<modalities:map<string,array<string>>,"
    "`normalization values`:map<string,array<array<double>>>>,"
    " HYPERPARAMETERS struct<`batch size`:int,epochs:int,optimizer:string,`learning rate`:double,"
    "`weight decay`:double,momentum:double,loss:string,alpha:array<array<double>>,gamma:double>,"
    " MODEL struct<encoder:string,weights:string,attention:string,model:string>,"
    " TRAINING struct<`training loss`:array<double>,`training accuracy`:array<double>,"
    "`validation loss`:array<double>,`validation accuracy`:array<double>>"
)


def read_run_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per run record (nested JSON), with the file it came from."""
    return spark.read.schema(RUN_SCHEMA).json(path, multiLine=True).withColumn(
        "source", F.col("_metadata.file_path")
    )


def training_curves(runs: DataFrame) -> DataFrame:
    """Per epoch losses and accuracies out of run records; NULL where a record lacks a series."""
    t = F.col("TRAINING")
    fields = ["training loss", "training accuracy", "validation loss", "validation accuracy"]
    none = F.array().cast("array<double>")
    zipped = F.arrays_zip(*[F.coalesce(t[f], none).alias(f.replace(" ", "_")) for f in fields])
    rows = runs.select(F.col("NAME").alias("run"), F.posexplode(zipped).alias("pos", "e"))
    return rows.select(
        "run",
        (F.col("pos") + 1).alias("epoch"),
        *[F.col("e")[f.replace(" ", "_")].alias(f.replace(" ", "_")) for f in fields],
    )


def discover(spark: SparkSession, pattern: str) -> DataFrame:
    """Paths that match a glob, as rows ``path``; contents are not read."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select("path")


def first_match(spark: SparkSession, pattern: str) -> str | None:
    """The first path in name order, so that the choice is repeatable."""
    return discover(spark, pattern).agg(F.min("path")).first()[0]
