"""Near copies by SimHash: wide fingerprints of five-word shingles, deletion-variant signatures, and the texts' own similarity.

Texts of a Jaccard similarity of 0.8 differ in about 15 % of their fingerprints' bits, so 64 bits and a distance of 3 find few of
them. Here a fingerprint has 1024 bits: 40 segments of 24 bits are indexed and 64 bits are a sketch. In some segment two similar
texts differ by one bit at most, and that bit is one of those whose sums were nearly even; so each segment is indexed with one of
its six least certain bits deleted. Pairs come from equal signatures, the sketch drops accidental ones, and the texts decide.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braid.llm.batches import over_texts
from braid.llm.common import dropped, freed, text_or_empty, written
from braid.llm.components import components

SHINGLE, SIMILARITY = 5, (4, 5)
SEGMENTS, WIDTH, WILDCARDS = 40, 24, 6
WORDS = 16
#: Differing bits of the sketch's 64 at most. A similarity of 0.8 gives 10 on average, with a deviation of 3; unlike texts 32.
SKETCH = 22
#: Differing bits of all 1024 at most, where texts of different components are compared. A similarity of 0.8 gives 155 on average,
#: with a deviation of 11.5; one of 0.65 gives 216.
BITS = 196
#: Texts of fewer shingles pass that test whatever their bits.
SHORT = 50
#: Buckets of up to so many members are compared whole, if their components differ; of larger ones, so many members a round.
SMALL, LEADERS = 256, 64
#: Shingles whose bits are summed at once: so many fit one byte.
BLOCK = 255
_odd = np.random.default_rng(42).integers(0, 1 << 63, (2, WORDS), dtype=np.uint64)
ADD, FACTOR = _odd[0], _odd[1] * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> frozenset[bytes]:
    """Distinct runs of five words, or all words of a shorter text. Words are cut and lower-cased as for fingerprints."""
    words = text.lower().split()
    if not words:
        return frozenset()
    return frozenset(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))) if len(words) >= SHINGLE else frozenset([b" ".join(words)])


def similar(a: frozenset, b: frozenset) -> bool:
    """Jaccard of 0.8 or more, in whole numbers; two texts without words are alike."""
    both = len(a & b)
    return SIMILARITY[1] * both >= SIMILARITY[0] * (len(a) + len(b) - both)


def sums(text: bytes) -> tuple[np.ndarray, int]:
    """For each of 1024 bits, how many more of the distinct shingles' hashes have it than not; and the number of shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(64 * WORDS, np.int64), 0
    numbers: dict[bytes, int] = {}
    at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    one = np.fromiter(map(xxh64_intdigest, numbers), np.uint64, len(numbers))[at]
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        hashes = (hashes ^ hashes >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + one[k : n + k]
    hashes = np.unique(hashes)
    out = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(hashes), BLOCK):
        h = hashes[i : i + BLOCK, None] * FACTOR + ADD
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        out += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return 2 * out - len(hashes), len(hashes)


def segments(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The segments' bits, their least certain bits' numbers, and the sketch."""
    bits = margin > 0
    cut = margin[: SEGMENTS * WIDTH].reshape(SEGMENTS, WIDTH)
    value = bits[: SEGMENTS * WIDTH].reshape(SEGMENTS, WIDTH) @ (1 << np.arange(WIDTH))
    weak = np.argsort(np.abs(cut), axis=1, kind="stable")[:, :WILDCARDS]
    return value, weak, int(np.packbits(bits[SEGMENTS * WIDTH :]).view(np.int64)[0])


_AT = f"cast(i div {WILDCARDS} as int)"
_KEY = f"shiftleft(cast({_AT} as bigint), 32) | shiftleft(cast(w as bigint), 24) | (cast(segments[{_AT}] as bigint) & ~shiftleft(1L, cast(w as int)))"
#: SQL of the keys of the deletion variants: the segment's number, the deleted bit's, and the segment without it.
SIGNATURES = f"transform(weak, (w, i) -> {_KEY})"
#: SQL of the keys with forms: which bits of the segment are deleted somewhere, and above them the bit that is deleted here.
FORMS = f"transform(weak, (w, i) -> struct({_KEY} as key, masks[{_AT}] | shiftleft(shiftright(segments[{_AT}], cast(w as int)) & 1, {WIDTH}) as form))"
#: SQL: the first of the keys that a member and its hub share in a segment. Where the deleted bits differ there is no other; where
#: they are the same, so are the segments, and each bit that both delete somewhere is one.
FIRST = f"(shiftright(form ^ hub.form, {WIDTH}) = 1 OR (form & hub.form & (shiftleft(1, cast(shiftright(key, 24) & 255 as int)) - 1)) = 0)"

#: SQL: the deleted bits of the keys that two members share in segment j, and whether a key is the first they share in any segment.
_SHARED = "CASE bit_count(segments[{j}] ^ segments_b[{j}]) WHEN 0 THEN masks[{j}] & masks_b[{j}] WHEN 1 THEN masks[{j}] & masks_b[{j}] & (segments[{j}] ^ segments_b[{j}]) ELSE 0 END"
_SEGMENT = "cast(shiftright(key, 32) as int)"
FIRST_OF_ALL = f"(({_SHARED.format(j=_SEGMENT)}) & (shiftleft(1, cast(shiftright(key, 24) & 255 as int)) - 1)) = 0 AND forall(slice(array({', '.join(map(str, range(SEGMENTS)))}), 1, {_SEGMENT}), j -> ({_SHARED.format(j='j')}) = 0)"


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, node, size, sketch, segments, weak, masks): a hash of the text, its number of distinct shingles, and what its signatures are
    made of, which is a tenth of their size."""

    def make():
        def f(batch):
            size, sketch, values, weak, masks = [], [], [], [], []
            for t in batch.column(2).cast(pa.binary()).to_pylist():
                margin, n = sums(t)
                v, w, s = segments(margin)
                size.append(n)
                sketch.append(s)
                values.append(v)
                weak.append(w.ravel())
                masks.append(np.bitwise_or.reduce(1 << w, axis=1))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * n, pa.int32()), pa.array(np.concatenate(x), kind)) for x, n, kind in ((values, SEGMENTS, pa.int32()), (weak, SEGMENTS * WILDCARDS, pa.int8()), (masks, SEGMENTS, pa.int32()))]
            columns = [batch.column(0), batch.column(1), pa.array(size, pa.int32()), pa.array(sketch, pa.int64()), *lists]
            return pa.RecordBatch.from_arrays(columns, [id_col, "node", "size", "sketch", "segments", "weak", "masks"])

        return f

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col), F.xxhash64(text).alias("node"), text.alias("__text"))
    return over_texts(rows, "__text", make, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, node long, size int, sketch long, segments array<int>, weak array<tinyint>, masks array<int>")


def verified(pairs: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(a, b): the pairs whose texts are similar. A member of many pairs is the crowded side of a merge join, which can be split."""

    def make():
        def f(batch):
            a, b, left, right = batch.columns
            near, last, one = [], None, frozenset()
            for x, y in zip(left.cast(pa.binary()).to_pylist(), right.cast(pa.binary()).to_pylist()):
                if x != last:
                    last, one = x, shingles(x)
                near.append(similar(one, shingles(y)))
            keep = pa.array(near, pa.bool_())
            return pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

        return f

    text = text_or_empty(text_col)
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = written(docs.select(F.xxhash64(text).alias("node"), text.alias("text")).join(needed.hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node"]), "texts")
    out = pairs
    for side in ("b", "a"):
        out = out.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")).hint("merge"), side)
    out = written(over_texts(out.select("a", "b", "text_a", "text_b"), "text_a", make, "a long, b long"), "similar")
    dropped(texts)
    return out


def like(size: str, sketch: str, other_size: str, other_sketch: str) -> str:
    """SQL: sizes that allow the similarity, and sketches near enough."""
    return f"{SIMILARITY[1]} * least({size}, {other_size}) >= {SIMILARITY[0]} * greatest({size}, {other_size}) AND bit_count({sketch} ^ {other_sketch}) <= {SKETCH}"


def meetings(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """The members (key, node, size, sketch, form) with the hub of their bucket, where it may be similar: once for each segment in
    which they meet, not for each of its keys. A hub that is left out at a key is in the bucket of the first one, whose hub is it
    or has more company."""
    return members.join(hubs.hint("merge"), "key").filter(f"node <> hub.node AND {FIRST}").filter(like("size", "sketch", "hub.size", "hub.sketch"))


def nearer() -> str:
    """SQL: all bits of a member and of another (with _b) near enough, or texts so short that bits say little."""
    return f"(least(size, size_b) < {SHORT} OR " + " + ".join(["bit_count(sketch ^ sketch_b)", *(f"bit_count(segments[{i}] ^ segments_b[{i}])" for i in range(SEGMENTS))]) + f" <= {BITS})"


def joined(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels (node, label) after the links (a, b): a round of components over what are components so far."""
    of = {side: labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")) for side in "ab"}
    across = found.join(of["a"], "a").join(of["b"], "b").filter("label_a <> label_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()
    merged = components(across).select(F.col("node").alias("label"), F.col("label").alias("into"))
    out = written(labels.join(merged, "label", "left").select("node", F.coalesce("into", "label").alias("label")), "labels")
    dropped(labels)
    return out


def others(rows: DataFrame) -> DataFrame:
    """The rows as the other members of their buckets: node is b there, other columns end in _b."""
    return rows.select(*[F.col(c).alias({"key": "key_b", "node": "b"}.get(c, f"{c}_b")) for c in ("key", "node", "size", "sketch", "label", "rank", "segments", "masks") if c in rows.columns])


def neighbours(left: DataFrame, leaders: int) -> DataFrame:
    """(node) of the members that have one near by size and sketch among those they are compared with. A member counts once in its
    bucket, however many are near."""
    led, like_other = f"rank <= {leaders}", f"key = key_b AND label <> label_b AND {like('size', 'sketch', 'size_b', 'sketch_b')}"
    met = left.join(others(left.filter(f"rank IS NULL OR {led}")).hint("merge"), F.expr(f"{like_other} AND node <> b"), "left_semi")
    leading = left.filter(led).join(others(left.filter(f"rank > {leaders}")).hint("merge"), F.expr(like_other), "left_semi")
    return met.select("node").union(leading.select("node")).distinct()


def paired(left: DataFrame, leaders: int) -> DataFrame:
    """Members of one bucket in different components that are near by all bits: each with those after it in small buckets, which
    have no ranks, and with those before it among the first so many in large ones. Two members that share many keys make a row at
    the first of them only: its bucket is open until it is one component or they have been compared there."""
    once = "(rank IS NULL AND node < b OR rank_b < rank)"
    near = f"{like('size', 'sketch', 'size_b', 'sketch_b')} AND {nearer()}"
    other = others(left.filter(F.col("rank").isNull() | (F.col("rank") <= leaders)))
    return left.join(other.hint("merge"), F.expr(f"key = key_b AND {once} AND label <> label_b AND {near} AND {FIRST_OF_ALL}"))


def groups(rows: DataFrame, docs: DataFrame, text_col: str, small: int = SMALL, leaders: int = LEADERS) -> DataFrame:
    """(node, label) of the texts that share a signature with another: the components of similar texts that do.

    A bucket's hub is its member with the most company over all buckets. First each text is compared with the greatest hub that it
    meets, which makes most groups of copies one component with a pair for each member; then with its other hubs, where their
    components differ. Of buckets that still hold several components, small ones are compared as a whole, of large ones members of
    the smallest components with all others; pairs within a component and pairs that were tested don't matter. A member that met
    all others leaves, so nothing is lost and no bucket gives its pairs while it is one component.
    """
    spark = rows.sparkSession
    member = ["node", "size", "sketch"]
    node = written(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "sketch", "segments", "weak", "masks")]), "nodes")
    sizes = written(node.select(F.explode(F.expr(SIGNATURES)).alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    freed(spark)
    members = written(node.select(*member, F.inline(F.expr(FORMS))).join(sizes.hint("merge"), "key"), "members")
    dropped(sizes)
    freed(spark)
    prints = node.select("node", "segments", "masks")
    company = written(members.groupBy("node").agg(F.sum("n").alias("company")), "company")
    hubs = members.join(company.hint("shuffle_hash"), "node").groupBy("key").agg(F.max(F.struct("company", *member, "form")).alias("hub"))
    # a hub of many pairs is the left text while it is compared
    met = written(meetings(members, hubs).groupBy(F.col("hub.node").alias("a"), F.col("node").alias("b")).agg(F.max("hub.company").alias("company")), "met")
    labels = written(company.select("node", F.col("node").alias("label")), "labels")
    best = written(met.groupBy("b").agg(F.max(F.struct("company", "a")).alias("hub")).select("hub.a", "b"), "best")
    labels = joined(labels, verified(best, docs, text_col))
    freed(spark)
    sides = [labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")) for side in "ab"]
    others = met.join(best, ["a", "b"], "left_anti").join(sides[0], "a").join(sides[1], "b").filter("label_a <> label_b")
    pairs = written(others.select("a", "b"), "pairs")
    open_, tested = members, met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    while True:
        if not pairs.isEmpty():
            labels = joined(labels, verified(pairs, docs, text_col))
        weights = labels.join(labels.groupBy("label").agg(F.count("*").alias("weight")), "label")
        named = written(open_.select("key", *member).join(weights.hint("merge"), "node"), "named")
        mixed = named.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
        left = written(named.join(mixed.hint("merge"), "key").drop("low", "high"), "open")
        dropped(named)
        dropped(open_)
        freed(spark)
        if left.isEmpty():
            dropped(node)
            return labels
        rank = F.row_number().over(Window.partitionBy("key").orderBy("weight", "node"))
        mixed, left = left, written(left.withColumn("rank", F.when(F.col("n") > small, rank)), "ranked")
        dropped(mixed)
        # which members have anyone near by the sketch; only they bring all their bits along
        near = written(neighbours(left, leaders).join(prints, "node"), "near")
        close = paired(left.join(near.hint("merge"), "node"), leaders)
        close = close.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        pairs = written(close.join(tested, ["a", "b"], "left_anti"), "pairs")
        dropped(near)
        tested = written(tested.union(pairs), "tested")
        open_ = written(left.filter(F.col("rank") > leaders).select("key", *member), "rest")
        dropped(left)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, leaders: int = LEADERS) -> DataFrame:
    """One row per input row: id_col, component_id (the least id that is reachable over pairs of similar texts, itself included).

    Texts of any length count whole. Null texts are empty. Null ids don't count for component_id, which is null where a
    component has no other. Rows that repeat an id are rows of their own. Empty tables give empty results.
    """
    rows = written(signed(docs, id_col, text_col), "signed")
    nodes = written(rows.groupBy("node").agg(F.min(id_col).alias("least")), "nodes")
    labels = groups(rows, docs, text_col, small, leaders)
    rooted = nodes.join(labels, "node", "left").withColumn("root", F.coalesce("label", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(rooted.select("node", "root").join(least, "root").select("node", "component_id"), "component")
    return rows.join(of, "node").select(id_col, "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each component. Rows that repeat that id all stay. The columns of docs stay."""
    found = near_components(docs)
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(keep.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(keep["__keep"]), "left_semi")
