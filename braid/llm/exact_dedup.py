"""Exact duplicates: a tree merge of digest runs, in DataFrame operations only."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.llm.common import documents, n_partitions, text_or_empty, written

KEY = ["digest", "n_bytes", "second"]
#: A round merges 2 ** FAN_BITS runs. Digest ranges are finer by SPREAD_BITS than the rounds need, so that they even out.
FAN_BITS, SPREAD_BITS = 2, 6


def digest_rows(docs: DataFrame, id_col: str, text_col: str, runs: int) -> DataFrame:
    """(id, digest, n_bytes, second, run): SHA-256, length and an independent hash; texts count as equal if all three agree."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("second"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(runs)).cast("int").alias("run"),
    )


def merged_runs(entries: DataFrame, run, bits: int, best: str) -> DataFrame:
    """One level: entries (KEY, run, best, n) of the given runs meet by run and digest range, each partition sorts them by key and
    streams equal keys, which lie together then, into one entry. The aggregate is over a struct, so Spark plans it as a merge of
    sorted rows and not as a hash table; its keys hold the exchange's, so there is no other exchange."""
    pick = F.max if best == "max" else F.min
    missing = (F.isnotnull("best") if best == "max" else F.isnull("best")).alias("rank")  # a null id is the last choice
    ranged = entries.select(*KEY, run.cast("int").alias("run"), F.expr(f"shiftrightunsigned(second, {64 - bits})").alias("range"), "best", "n")
    dealt = ranged.repartition("run", "range")
    out = dealt.groupBy("run", "range", *KEY).agg(pick(F.struct(missing, "best")).alias("top"), F.sum("n").alias("n"))
    return out.select(*KEY, "run", F.col("top.best").alias("best"), "n")


def tree_merge(leaves: DataFrame, levels: int, keep: str) -> DataFrame:
    """The root of a tree over 2 ** (FAN_BITS * levels) sorted runs.

    In round r, the partitions whose runs differ in digit r only exchange runs: each takes one more digit of the digest and merges
    what all of them have of its range. So every round merges 2 ** FAN_BITS runs, works on as many partitions as the first, and
    moves each entry once; the last round's partitions each hold one range of the single run that is left.
    """
    level = leaves
    for r in range(1, levels + 1):
        level = merged_runs(level, F.shiftright("run", FAN_BITS), FAN_BITS * r + SPREAD_BITS, keep)
    return level.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", levels: int | None = None) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Rows are dealt to runs by a hash of their id, at least as many as partitions. Each run is first reduced to one entry per text
    (a group of copies shrinks map-side), then runs merge round by round; each keeps the best id and the count of texts whose
    SHA-256, length and second hash all agree. The root goes back down by (digest, run): a group of copies is spread over all
    runs there, so no key holds more than its share of one run.

    Null texts equal empty ones. Rows that repeat an id and its text all carry the same values, so all of them stay or go.
    A null id stays only where every id of its group is null. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    if levels is None:
        levels = 1
        while 1 << (FAN_BITS * levels) < n_partitions(spark):
            levels += 1
    rows = written(digest_rows(docs, id_col, text_col, 1 << (FAN_BITS * levels)), "digests")
    best = F.max if keep == "max" else F.min
    leaves = rows.groupBy(*KEY, "run").agg(best("id").alias("best"), F.count("*").alias("n"))
    root = tree_merge(leaves, levels, keep)
    down = leaves.select(*KEY, "run").join(root, KEY)
    return rows.join(down, [*KEY, "run"]).select(
        F.col("id").alias(id_col),
        F.col("best").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("best")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops all but one id of each group of equal texts. The columns of docs stay. Rows that repeat a kept id all stay."""
    keep = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(keep.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(keep["__keep"]), "left_semi")
