"""Samples in files: CSV rows, fixed-size binary records, one file a sample, run logs; and the writers beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accrete.functions.text import unsigned

SAMPLE = T.StructType([T.StructField("path", T.StringType()), T.StructField("sample_index", T.LongType()), T.StructField("label", T.LongType()), T.StructField("payload", T.BinaryType())])


def csv_samples(spark: SparkSession, path: str, columns: int, label_index: int, separator: str = ",", quote: str = '"', header: bool = False, order_by: int | None = None) -> DataFrame:
    """path, sample_index, label and payload (the row without its label, joined by the separator).

    A row's index in its file is its place in file order: files are read as single splits where indices are needed.
    """
    names = [f"c{i}" for i in range(columns)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.csv(path, schema=schema, sep=separator, quote=quote, header=header, multiLine=True).withColumn("path", F.input_file_name()).withColumn("_at", F.monotonically_increasing_id())
    others = [F.coalesce(F.col(n), F.lit("")) for i, n in enumerate(names) if i != label_index]
    index = F.row_number().over(Window.partitionBy("path").orderBy(names[order_by] if order_by is not None else "_at")) - 1
    return rows.select("path", index.cast("long").alias("sample_index"), F.col(names[label_index]).cast("long").alias("label"), F.concat_ws(separator, *others).cast("binary").alias("payload"))


def record_samples(spark: SparkSession, path: str, record_size: int, label_size: int, little: bool = True) -> DataFrame:
    """The same of fixed-size records, each a label and a payload; a file of another size fails."""
    files = spark.read.format("binaryFile").load(path)
    whole = F.when(F.col("length") % record_size == 0, F.col("length") / record_size).otherwise(F.raise_error(F.concat(F.lit("not whole records: "), F.col("path"))))
    places = F.explode(F.when(F.col("_n") > 0, F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).otherwise(F.array().cast("array<int>")))
    rows = files.withColumn("_n", whole).select("path", places.alias("i"), "content")
    rows = rows.select("path", F.col("i").cast("long").alias("sample_index"), F.expr(f"substring(content, i * {record_size} + 1, {record_size})").alias("_r"))
    return rows.select("path", "sample_index", unsigned(F.col("_r"), label_size, little).alias("label"), F.expr(f"substring(_r, {label_size + 1})").alias("payload"))


def single_samples(spark: SparkSession, path: str, extension: str, label_extension: str) -> DataFrame:
    """One sample a file; its label is in the file of the same name with another extension."""
    read = lambda e: spark.read.format("binaryFile").option("pathGlobFilter", f"*{e}").option("recursiveFileLookup", "true").load(path).withColumn("_stem", F.expr(f"substring(path, 1, length(path) - {len(e)})"))
    labels = read(label_extension).select("_stem", F.trim(F.col("content").cast("string")).cast("long").alias("label"))
    return read(extension).join(labels, "_stem").select("path", F.lit(0).cast("long").alias("sample_index"), "label", F.col("content").alias("payload"))


READERS: dict[str, Callable[..., DataFrame]] = {"csv": csv_samples, "records": record_samples, "single": single_samples}


def read_samples(kind: str, *args, **options) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"unknown kind of file: {kind}; known: {', '.join(READERS)}")
    return READERS[kind](*args, **options)


def listing(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """path, updated_at (seconds) and size of all files below a folder with an extension."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.unix_seconds("modificationTime").alias("updated_at"), F.col("length").alias("size"))


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """The stage rows of JSON run logs, one file a run."""
    return spark.read.json(path, multiLine=True)


def write_training_set(rows: DataFrame, path: str) -> None:
    """key and weight of each trigger and partition, replacing only partitions that occur in rows."""
    rows.write.partitionBy("trigger_id", "partition_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_training_set(spark: SparkSession, path: str, trigger: int, partition: int | None = None) -> DataFrame:
    """Pruned to the folders of the trigger and partition."""
    got = spark.read.parquet(path).where(F.col("trigger_id") == trigger)
    return got if partition is None else got.where(F.col("partition_id") == partition)


def pick(samples: DataFrame, indices: list[int]) -> DataFrame:
    """The samples at these places of their files; each index once."""
    return samples.where(F.col("sample_index").isin(sorted(set(indices))))


def without(samples: DataFrame, indices: list[int]) -> DataFrame:
    """What is left when these places are deleted, with the places that the rows have then."""
    deleted = sorted(set(indices))
    before = F.size(F.filter(F.array(*[F.lit(i) for i in deleted]).cast("array<bigint>"), lambda i: i < F.col("sample_index")))
    return samples.where(~F.col("sample_index").isin(deleted)).withColumn("sample_index", F.col("sample_index") - before)


def drop_empty_files(files: DataFrame, samples: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files and samples (file_id, key) without the samples of keys; a file goes only when all its samples go."""
    left = samples.join(keys.select("key").distinct(), "key", "left_anti")
    return files.join(left.select("file_id").distinct(), "file_id", "left_semi"), left


def write_rows(rows: DataFrame, path: str, label: str, separator: str = ",") -> None:
    """A CSV file with the label in its first column, in the order of the rows' place column `at`."""
    others = [c for c in rows.columns if c not in (label, "at")]
    rows.orderBy("at").select(label, *others).coalesce(1).write.csv(path, sep=separator)


def write_periods(rows: DataFrame, path: str, period: str) -> None:
    """Tab-separated files, one folder a period; the period is a column of its own and not the files' time."""
    rows.write.partitionBy(period).mode("append").csv(path, sep="\t")


def append_state(rows: DataFrame, path: str) -> None:
    """Samples of a pipeline as they come in: one folder a pipeline and trigger."""
    rows.write.partitionBy("pipeline_id", "trigger_id").mode("append").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Stage rows as JSON lines, beside those written before."""
    rows.write.mode("append").json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_losses(rows: DataFrame, path: str) -> None:
    """Per-sample losses of a training; samples without one are left out."""
    rows.where("loss is not null").write.mode("append").parquet(path)
