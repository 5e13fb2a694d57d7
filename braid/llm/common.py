"""Helpers shared by the training-data operators."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that end a word: space and the controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where that is unset, a single JVM gets a temporary folder (tests);
    on a cluster, where executors don't share one, it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        sc = spark.sparkContext
        set_dir = sc._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            where = set_dir.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            where = "file://" + tempfile.mkdtemp(prefix="braid-")
            sc.setCheckpointDir(where)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here and no later step repeats the work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/braid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._braid_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table made by written(), once nothing lazy reads it, and lets Spark free the shuffle files of the past."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._braid_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def freed(spark: SparkSession) -> None:
    """Asks the driver's JVM to collect garbage, so that shuffle files nothing refers to are removed between phases."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z only. Where a text is all ASCII, lower() does the same and is faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
