"""Lines that many documents share: range-partitioned line hashes, and keep bitmaps per document, in DataFrame operations only."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.llm.common import SPACES, ascii_lower, documents, dropped, n_partitions, text_or_empty, written

BITS = 63
FULL = (1 << BITS) - 1
#: Bitmaps of so many bytes at most are sent to all executors.
BROADCAST_BYTES = 16 << 20


def line_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_id, row_hash, pos, h1, h2): a row for each line whose key isn't empty; two hashes of the key."""
    text = text_or_empty(text_col)
    keys = F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.trim(x, F.lit(SPACES)))
    return (
        docs.select(*row_key(id_col, text_col), F.posexplode(keys).alias("pos", "key"))
        .filter(F.col("key") != "")
        .select("row_id", "row_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"))
    )


def row_key(id_col: str, text_col: str):
    """Names a row: its id and a hash of its text, so that two texts under one id stay apart. No part is null."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("row_id"), F.xxhash64(text_or_empty(text_col)).alias("row_hash")


def first_occurrences(lines: DataFrame, n: int) -> DataFrame:
    """(h1, h2, n_docs, first): lines are range-partitioned by hash, document and position, so a common line is cut over several
    partitions, and sorted; the ranges already hold each document's copies of a line together, so each partition streams its runs
    into one place per document and from there into partial counts, without another exchange of lines."""
    row = ["h1", "h2", "row_id", "row_hash"]
    ordered = lines.repartitionByRange(n, *row).sortWithinPartitions(*row, "pos").groupBy(*row).agg(F.min("pos").alias("pos"))
    return ordered.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.min(F.struct("row_id", "row_hash", "pos")).alias("first"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """(row_id, row_hash, bitmap array<struct<word, mask>>): bit p mod 63 of word p div 63 is set if line p stays. Words whose lines
    all stay aren't stored and documents that keep all lines have no row. keep_first leaves each line's first place.

    Only hashes, places and bitmaps are exchanged, never a text. The result is a written table.
    """
    lines = written(line_keys(docs, id_col, text_col), "lines")
    # written, so that both sides of the join below are plain exchanges and a common line's partition can be split
    common = written(first_occurrences(lines, n_partitions(docs.sparkSession)).filter(F.col("n_docs") >= min_docs), "common")
    gone = lines.join(common, ["h1", "h2"])
    if keep_first:
        gone = gone.filter(F.struct("row_id", "row_hash", "pos") != F.col("first"))
    words = gone.groupBy("row_id", "row_hash", F.floor(F.col("pos") / BITS).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, pos % {BITS})")).bitwiseXOR(F.lit(FULL)).alias("mask")
    )
    bitmaps = written(words.groupBy("row_id", "row_hash").agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("bitmap")), "bitmaps")
    dropped(lines)
    dropped(common)
    return bitmaps


def dropped_positions(bitmap: str):
    return F.expr(
        f"flatten(transform({bitmap}, w -> filter(transform(sequence(0, {BITS - 1}), b -> w.word * {BITS} + b), p -> (shiftright(w.mask, p % {BITS}) & 1L) = 0L)))"
    )


def applied(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
    """id_col, n_lines, n_dropped, kept_text, bitmap for each row of docs. Bitmaps of up to limit bytes in all, which are counted
    first, go to the texts; beyond it both sides are exchanged by row."""
    bytes_ = bitmaps.agg(F.sum(F.octet_length("row_id") + 32 + 16 * F.size("bitmap"))).first()[0] or 0
    few = F.broadcast(bitmaps) if bytes_ <= limit else bitmaps.hint("shuffle_hash")
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"), *row_key(id_col, text_col))
    joined = rows.join(few, ["row_id", "row_hash"], "left")
    gone = F.when(F.col("bitmap").isNull(), F.array().cast("array<int>")).otherwise(dropped_positions("bitmap"))
    kept = F.when(F.col("bitmap").isNull(), F.col("__text")).otherwise(
        F.expr("array_join(transform(array_except(sequence(0, size(__lines) - 1), __gone), p -> __lines[p]), '\n')")
    )
    return joined.select("__id", "__text", "bitmap", F.split("__text", "\n", -1).alias("__lines"), gone.alias("__gone")).select(
        F.col("__id").alias(id_col), F.size("__lines").cast("long").alias("n_lines"), F.size("__gone").cast("long").alias("n_dropped"), kept.alias("kept_text"), "bitmap"
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row per input row: id_col, n_lines, n_dropped, kept_text, bitmap (null where all lines stay).

    A line's key is its text without spaces at its ends, A-Z in lower case. Keys found in at least min_docs rows lose all their
    lines; empty keys never do. Null and empty texts are one empty line. A line counts once per row; rows that repeat an id and
    its text count once. Documents of any length are one row of one task. Empty tables give empty results. Keys are told apart by
    128 bits of hashes.
    """
    return applied(docs, keep_bitmaps(docs, id_col, text_col, min_docs), id_col, text_col, limit)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """The bitmaps, as text, and what they leave of each document."""
    out = line_dedup(documents(spark, sf_dir))
    words = F.transform("bitmap", lambda w: F.concat(w["word"].cast("string"), F.lit(":"), F.lower(F.hex(w["mask"]))))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), F.array_join(words, ",").alias("keep_bitmap"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
judged AS (SELECT *, k IN (SELECT k FROM common) AS gone FROM keyed),
words AS (
  SELECT doc_id, (pos - 1) // 63 AS word, 9223372036854775807 - sum(1::BIGINT << ((pos - 1) % 63)::INT)::BIGINT AS mask
  FROM judged WHERE gone GROUP BY ALL),
bitmaps AS (SELECT doc_id, string_agg(word || ':' || lower(hex(mask)), ',' ORDER BY word) AS keep_bitmap FROM words GROUP BY doc_id)
SELECT doc_id, count(*) AS n_lines,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256,
       any_value(keep_bitmap) AS keep_bitmap
FROM judged LEFT JOIN bitmaps USING (doc_id) GROUP BY doc_id
"""
