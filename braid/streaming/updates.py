"""Profiles from streams: extraction and normalization run on a stream as they are; fusion keeps a table of the latest record of
each (candidate, source) and fuses the candidates that a batch touches."""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from braid.config import FusionConfig
from braid.operators.merge import merge_profiles, normalized
from braid.operators.projection import project_json
from braid.operators.validation import profile_warnings

#: Folders of the state by key: a batch reads those of its keys only.
BUCKETS = 256
#: A snapshot of the state is written after so many batches, and batches before it aren't read any more.
COMPACT = 20


def latest(records: DataFrame) -> DataFrame:
    """Of each (candidate_key, source, seq) the record of the last batch."""
    order = Window.partitionBy("candidate_key", "source", "seq").orderBy(F.desc("batch"))
    return records.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def folders(spark: SparkSession, state: str, n: int) -> list[str]:
    """The last snapshot before batch n and the batches after it, batch n included."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [m for m in (re.fullmatch(r"(batch|snapshot)-(\d+)", f.getPath().getName()) for f in found) if m]
    last = max((int(m[2]) for m in names if m[1] == "snapshot" and int(m[2]) < n), default=-1)
    return [f"{state}/{m[0]}" for m in names if m[1] == "batch" and last < int(m[2]) <= n or m[1] == "snapshot" and int(m[2]) == last]


def fuse_stream(profiles: DataFrame, state: str, output: str, checkpoint: str, cfg: FusionConfig | None = None, once: bool = False, config: dict | None = None, buckets: int = BUCKETS, compact: int = COMPACT) -> StreamingQuery:
    """Writes canonical profiles of touched candidates, with their warnings, to output/batch=N, and the records themselves to state.
    With a projection config, the output holds (candidate_key, json) instead.

    A batch replaces its own folders only, so one that is run again after a failure writes the same again. State lies in folders by
    a hash of the key: a batch reads the folders of its keys, at most `buckets` of them. No state is held in memory. Records without
    a key are left out.
    """
    spark = profiles.sparkSession
    bucket = F.pmod(F.xxhash64("candidate_key"), F.lit(buckets)).cast("int")

    def step(batch: DataFrame, n: int) -> None:
        rows = batch.filter("candidate_key is not null").withColumns({"batch": F.lit(n), "bucket": bucket})
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/batch-{n}")
        mine = spark.read.schema(rows.schema).parquet(f"{state}/batch-{n}")
        touched = [r.bucket for r in mine.select("bucket").distinct().collect()]  # `buckets` numbers at most
        known = reduce(DataFrame.union, [spark.read.schema(rows.schema).parquet(x) for x in folders(spark, state, n)])
        near = known.filter(F.col("bucket").isin(touched))
        records = latest(near.join(mine.select("candidate_key").distinct(), "candidate_key", "left_semi")).drop("batch", "bucket")
        merged = merge_profiles(records, cfg)
        checked = merged.withColumn("warnings", profile_warnings(cfg))
        (checked if config is None else project_json(checked, config, cfg)).write.mode("overwrite").parquet(f"{output}/batch={n}")
        if (n + 1) % compact == 0:
            latest(known).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/snapshot-{n}")

    writer = normalized(profiles, cfg).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
