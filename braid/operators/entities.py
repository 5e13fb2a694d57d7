"""Which records of whole tables are of one candidate: classes of records that equal e-mails or phones connect."""
from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.config import FusionConfig
from braid.functions.scalars import normalize_phone
from braid.operators.matching import email_key


def kept(df: DataFrame) -> DataFrame:
    """df in the checkpoint folder, so that rounds don't repeat earlier ones. A single JVM without one gets a temporary folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="braid-"))
    return df.checkpoint()


def stars(records: DataFrame, cfg: FusionConfig | None = None) -> DataFrame:
    """(a, b): for each e-mail and phone, the least id that has it with every other. So a key that n records share gives n - 1 links
    and not n * n, and its least id comes from map-side combined minima."""
    cfg = cfg or FusionConfig()
    mail, phone = F.struct(F.lit("e").alias("by"), email_key(F.col("email")).alias("v")), F.struct(F.lit("p").alias("by"), normalize_phone(F.col("phone"), cfg).alias("v"))
    keyed = kept(records.filter("id is not null").select("id", F.explode(F.array(mail, phone)).alias("k")).filter("k.v is not null").distinct())
    least = keyed.groupBy("k").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").select("k", "a")
    return keyed.join(least, "k").filter("id <> a").select("a", F.col("id").alias("b")).distinct()


def entity_keys(records: DataFrame, cfg: FusionConfig | None = None) -> DataFrame:
    """(id, entity) for each id of records (id, email, phone): the least id that is reachable over equal e-mails and phones.

    Each round takes the least entity among a record and its neighbours, then the entity of that one, so a chain of n records takes
    about log n rounds. Ids that repeat are one record with all their e-mails and phones; null ids are left out.
    """
    links = stars(records, cfg)
    both = kept(links.union(links.select("b", "a")).distinct())
    own = records.filter("id is not null").select("id").distinct()
    found = kept(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("entity")))
    while True:
        near = both.join(found.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("entity").alias("near"))
        lower = kept(found.join(near, "id").select("id", F.least("entity", "near").alias("entity"), F.col("entity").alias("old")))
        up = lower.select(F.col("id").alias("entity"), F.col("entity").alias("above"))
        jumped = kept(lower.join(up, "entity").select("id", F.col("above").alias("entity"), "old"))
        found = jumped.select("id", "entity")
        if jumped.filter("entity <> old").isEmpty():
            return own.join(found, "id", "left").select("id", F.coalesce("entity", "id").alias("entity"))


def with_entity_keys(sources: dict[str, DataFrame], cfg: FusionConfig | None = None) -> dict[str, DataFrame]:
    """The sources with candidate_key replaced by the entity of each record, whichever source its other records are from. A source's
    own candidate_key names its records only, and may be missing: then each distinct row is a record."""
    named = {}
    for name, df in sources.items():
        row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("string")
        own = F.coalesce(F.col("candidate_key"), row) if "candidate_key" in df.columns else row
        named[name] = df.withColumn("candidate_key", F.concat(F.lit(name + ":"), own))
    rows = None
    for df in named.values():
        def values(one: str, many: str, df=df):
            single = F.array(F.col(one)) if one in df.columns else F.array().cast("array<string>")
            return F.explode_outer(F.array_distinct(F.concat(single, F.coalesce(F.col(many), F.array().cast("array<string>"))) if many in df.columns else single))

        mails = df.select(F.col("candidate_key").alias("id"), values("email", "emails").alias("email"), F.lit(None).cast("string").alias("phone"))
        phones = df.select(F.col("candidate_key").alias("id"), F.lit(None).cast("string").alias("email"), values("phone", "phones").alias("phone"))
        rows = mails.union(phones) if rows is None else rows.union(mails).union(phones)
    keys = entity_keys(rows, cfg)
    return {name: df.join(keys, df["candidate_key"] == keys["id"]).drop("id").withColumn("candidate_key", F.col("entity")).drop("entity") for name, df in named.items()}
