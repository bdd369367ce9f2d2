"""Writers: corpora by source and split, manifests, append logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as T


def counted_write(df: DataFrame, path: str, form: str = "json", by: tuple[str, ...] = ()) -> int:
    """Write a table and give the number of rows written; refuses to overwrite.

    The rows are counted in the files (parquet keeps counts in its footers): an observed count would leave state in the
    session that Spark ML's summaries cannot serialise.
    """
    df.write.mode("errorifexists").partitionBy(*by).format(form).save(path)
    return df.sparkSession.read.format(form).load(path).count()


def shuffled(df: DataFrame, key: str, seed: str, files: int) -> DataFrame:
    """Rows in the order of the seeded md5 of their key, in ``files`` ranges of it: a shuffle that every run repeats."""
    return df.withColumn("__h", T.hash_order(seed, F.col(key))).repartitionByRange(files, "__h").sortWithinPartitions("__h", key).drop("__h")


def write_corpus(corpus: DataFrame, path: str, form: str = "parquet", key: str | None = None, seed: str = "42", files: int = 64) -> int:
    """Write source=.../split=... folders and give the number of rows; refuses to overwrite.

    With ``key`` the rows of every folder are shuffled by its hash; one of the ``files`` ranges then gives a file a folder.
    """
    return counted_write(corpus if key is None else shuffled(corpus, key, seed, files), path, form, ("source", "split"))


def manifest(counters: DataFrame) -> str:
    """JSON of (source, stage, n) counters: {source: {stage: n}}; as many rows as sources times stages."""
    out: dict[str, dict[str, int]] = {}
    for r in counters.orderBy("source", "stage").collect():
        out.setdefault(r["source"], {})[r["stage"]] = r["n"]
    return json.dumps(out, indent=2)


def append_log(rows: DataFrame, path: str) -> None:
    """Append to a log of attempts; readers take the latest per key (``operators.taxonomy.latest``)."""
    rows.write.mode("append").json(path)


def exists(df: DataFrame, path: str) -> bool:
    """Whether an artifact is there already (skip-if-exists stages)."""
    spark = df.sparkSession
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def console_table(df: DataFrame, row: str, column: str, value: str, digits: int = 2) -> DataFrame:
    """A pivoted, formatted report table."""
    return df.groupBy(row).pivot(column).agg(F.format_number(F.first(value), digits))
