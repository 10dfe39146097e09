"""Reading data sets, logs and pictures, and writing samples and results."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a result table that one JSON document may hold.
MOST_RESULT_ROWS = 100_000


def dataset(spark: SparkSession, path: str, kind: str = "parquet", schema: str | T.StructType | None = None, **options: str) -> DataFrame:
    """A data set of any format Spark reads."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def json_array(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A file that is one JSON array, or many such files; a row an item."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def eval_log(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """The rows of ``logs`` in evaluation log files."""
    return json_array(spark, path, schema).select(F.explode("logs").alias("log")).select("log.*")


def split_of(docs: DataFrame, names: tuple[str, ...] = ("test", "val"), column: str = "split") -> DataFrame:
    """The rows of the first of the named splits that there are."""
    for name in names:
        part = docs.where(F.col(column) == name)
        if not part.isEmpty():
            return part
    return docs.limit(0)


def decoded(column: Column) -> Column:
    """Base64 text as bytes; null if it can't be decoded."""
    return F.try_to_binary(column, F.lit("base64"))


def with_files(docs: DataFrame, folder: str, column: str) -> DataFrame:
    """``docs`` with ``content``, the bytes of the file below ``folder`` that ``column`` names."""
    spark = docs.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/") + "/"
    named = files.select(F.split_part("path", F.lit(root), F.lit(2)).alias(column), "content")
    return docs.join(named, column, "left")


def without_pictures(docs: DataFrame) -> DataFrame:
    """``docs`` without binary columns, also inside of structs and arrays of them."""

    def binary(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return binary(kind.elementType)
        if isinstance(kind, T.StructType):
            return any(binary(f.dataType) for f in kind)
        return isinstance(kind, T.BinaryType)

    return docs.drop(*(f.name for f in docs.schema if binary(f.dataType)))


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as a file of any file system that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()


def write_samples(samples: DataFrame, path: str, task: str = "task", order: str = "doc_id", arguments: dict | None = None, configs: dict | None = None) -> None:
    """Per-sample results as JSON, a folder a task, in order of the document within each file.

    The ``arguments`` of the run and the ``configs`` of its models, where given, are in ``_run.json`` beside them, which readers of the samples skip.
    """
    samples.repartitionByRange(task, order).sortWithinPartitions(task, order).write.partitionBy(task).mode("overwrite").json(path)
    if arguments is not None or configs is not None:
        _write_text(samples.sparkSession, f"{path}/_run.json", json.dumps({"args": arguments or {}, "model_configs": configs or {}}, indent=2, sort_keys=True, default=str))


def write_results(results: DataFrame, path: str) -> None:
    """A result table as one JSON document ``{task: {"metric,filter": value, "metric_stderr,filter": stderr}}``."""
    rows = results.limit(MOST_RESULT_ROWS + 1).collect()
    if len(rows) > MOST_RESULT_ROWS:
        raise ValueError(f"more than {MOST_RESULT_ROWS} results")
    out: dict[str, dict[str, float | None]] = {}
    for r in rows:
        out.setdefault(r["task"], {}).update({f"{r['metric']},{r['filter']}": r["shown"], f"{r['metric']}_stderr,{r['filter']}": r["stderr"]})
    _write_text(results.sparkSession, path, json.dumps(out, indent=2, sort_keys=True))


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """A data set as Parquet, a folder a split."""
    rows.write.partitionBy(split).mode("overwrite").parquet(path)


def submission(samples: DataFrame, key: str, value: str, path: str) -> None:
    """Answers by key, as JSON lines."""
    samples.select(F.col(key).cast("string").alias("key"), F.col(value).alias("answer")).write.mode("overwrite").json(path)


def output_path(root: str, model: str, suffix: str, tasks: list[str], now: datetime) -> str:
    """The folder of a run."""
    return f"{root}/{model}/{now:%m%d_%H%M%S}_{suffix}_{model}_{'-'.join(tasks)}"
