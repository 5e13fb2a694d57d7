"""Near duplicates by SimHash: fingerprints, deletion-variant signatures, and components of links."""
from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.llm.batches import over_texts
from braid.llm.common import documents, dropped, n_partitions, text_or_empty, written
from braid.llm.components import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Members of a bucket that one numpy comparison takes; larger buckets are cut by more bits first.
BUCKET = 2048
#: Hashes whose bits are summed at once.
BLOCK = 1 << 16


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """Signed 64 bits: bit i is set if it is in over half of the shingles' hashes. 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: only A-Z become lower case, and only ASCII white space cuts
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(n))) if len(words) >= n else [words]
    hashes = np.fromiter(map(xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), np.uint64)
    sums = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8)
        sums += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * sums > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long) for each row."""

    def make():
        def f(batch):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t) for t in texts], pa.int64())], [id_col, "fp"])

        return f

    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("__text"))
    return over_texts(rows, "__text", make, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, fp long")


def variants(level: int) -> str:
    """SQL of the keys (array of structs k1, k2) of a fingerprint fp at a level.

    Within 3 bits of each other, two fingerprints have a 32-bit half in which they differ by one bit at most, so some copy of
    that half with one bit deleted is equal. The half not in the key still differs by 3 bits at most, so a crowded bucket's
    members can be cut by a 16-bit half of it in the same way, and then by 8 bits of what is left: then a bucket has 2 ^ 11
    fingerprints at most, whatever the data.
    """
    if level == 1:
        half = "if(j < 32, fp & 4294967295L, shiftrightunsigned(fp, 32))"
        return f"transform(sequence(0, 63), j -> struct(shiftleft(cast(j as bigint), 32) | ({half} & ~shiftleft(1L, j % 32)) AS k1, 0L AS k2))"
    other = "if(shiftright(k1, 32) < 32, shiftrightunsigned(fp, 32), fp & 4294967295L)"
    if level == 2:
        half = f"(shiftright({other}, if(j < 16, 0, 16)) & 65535L)"
        return f"transform(sequence(0, 31), j -> struct(k1 AS k1, shiftleft(1L, 40) | shiftleft(cast(j as bigint), 16) | ({half} & ~shiftleft(1L, j % 16)) AS k2))"
    rest = f"(shiftright({other}, if((shiftright(k2, 16) & 31) < 16, 16, 0)) & 65535L)"
    half = f"(shiftright({rest}, if(j < 8, 0, 8)) & 255L)"
    return f"transform(sequence(0, 15), j -> struct(k1 AS k1, shiftleft(1L, 62) | shiftleft(k2 & 2097151L, 16) | shiftleft(cast(j as bigint), 8) | ({half} & ~shiftleft(1L, j % 8)) AS k2))"


def linked(k1: np.ndarray, k2: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key: a spanning forest of the links among members of the same bucket, as pairs of fingerprints."""
    nodes, at = np.unique(fp, return_inverse=True)
    label = np.arange(len(nodes))
    left, right, step = [], [], 1
    while True:
        same = np.flatnonzero((k1[step:] == k1[:-step]) & (k2[step:] == k2[:-step]))
        if not len(same):
            break
        near = same[np.bitwise_count((fp[same] ^ fp[same + step]).view(np.uint64)) <= distance]
        left.append(at[near])
        right.append(at[near + step])
        step += 1
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        before = None
        while before is None or (label != before).any():
            before = label.copy()
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def bucket_links(members: DataFrame, n: int, distance: int) -> DataFrame:
    """(a, b): links within buckets of bounded size. A bucket that a batch's end cuts waits for the next batch."""

    def run(batches):
        rest = [np.empty(0, np.int64)] * 3
        for batch in batches:
            rows = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns)]
            k1, k2, _ = rows
            tail = len(k1) - int(np.argmax(((k1 != k1[-1]) | (k2 != k2[-1]))[::-1])) if (k1[0], k2[0]) != (k1[-1], k2[-1]) else 0
            a, b = linked(*[r[:tail] for r in rows], distance)
            rest = [r[tail:] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        a, b = linked(*rest, distance)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return members.select("k1", "k2", "fp").repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "fp").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, bucket: int = BUCKET, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links of distinct fingerprints fp, enough of them to connect all that are within the distance.

    Sizes of buckets are counted first, by map-side combined counts. Buckets of one member end there; those of up to `bucket`
    members are compared in numpy; larger ones are cut by more bits, at most twice, and counted again.
    """
    spark, n = distinct.sparkSession, n_partitions(distinct.sparkSession)
    # few bytes each, but 64 rows of keys: dealt out before they grow, as small inputs end up in few partitions
    found, used, crowd = [], [], distinct.repartition(n, "fp")
    for level in (1, 2, 3):
        keyed = crowd.select("fp", F.expr(f"explode({variants(level)})").alias("k")).select("fp", "k.k1", "k.k2")
        sizes = written(keyed.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
        # merged, however small sizes is: both sides are exchanged, and the partition of a crowded key can be split
        members = written(keyed.join(sizes.hint("merge"), ["k1", "k2"]), "members")
        dropped(sizes)
        used.append(members)
        found.append(written(bucket_links(members.filter(F.col("n") <= bucket) if level < 3 else members, n, distance), "found"))
        crowd = members.filter(F.col("n") > bucket).select("fp", "k1", "k2")
        if level == 3 or crowd.isEmpty():
            break
    for members in used:
        dropped(members)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, distance: int = DISTANCE) -> DataFrame:
    """One row per input row: id_col, fp, component_id (the least id that is reachable over links, itself included).

    Equal fingerprints are one node, so copies never make pairs. Null texts are empty: fingerprint 0, which links like any
    other. Ids that are null don't count for component_id, which is null where a component has no other. Rows that repeat an id
    are rows of their own. Texts of any length count whole. distance may be 3 at most; empty tables give empty results.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError("the signatures find up to 3 differing bits")
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    labels = components(links(nodes.select("fp"), bucket, distance))
    rooted = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("label", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "component")
    return rows.join(of, "fp").select(id_col, "fp", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
