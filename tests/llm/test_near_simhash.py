"""The near-copy stage against a comparison of all pairs, and its recall."""
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline
from braid.llm import near_simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randrange(20, 120))]
        texts.append(" ".join(base))
        for _ in range(r.randrange(6)):  # copies with a few words changed, some of them below the bound
            copy = list(base)
            for _ in range(r.randrange(1, 4)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy).upper())
    chain = [f"c{i}" for i in range(140)]
    texts += [" ".join(chain[i : i + 100]) for i in range(0, 40, 8)]  # each like the next only
    texts += ["one two", "ONE  two", "one", "", " \t", None]
    ids = random.Random(6).sample(range(1000), len(texts))
    return [*zip(ids, texts), (ids[0], texts[0]), (None, texts[3])]


def expected(rows):
    sets = [near_simhash.shingles((t or "").encode()) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            union = sets[i] | sets[j]
            if label[i] != label[j] and (not union or len(sets[i] & sets[j]) / len(union) >= 0.8):
                label = [label[j] if x == label[i] else x for x in label]
    return [min((i for (i, _), x in zip(rows, label) if x == y and i is not None), default=None) for y in label]


@pytest.mark.parametrize("small, leaders", [(64, 1), (1, 2)])
def test_components(spark, small, leaders):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(str, (tuple(x) for x in near_simhash.near_components(docs, small=small, leaders=leaders).collect())))
    assert got == sorted(str((i, c)) for (i, _), c in zip(rows, expected(rows)))
    assert near_simhash.near_components(docs.limit(0)).collect() == []


def test_stage_drops_near_copies(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("abcdefghijklmnopqrst") * 3 for _ in range(40)), "en", "s", 1) for i in range(30)]
    rows += [(100 + i, t + ".", "en", "s", 1) for i, t, *_ in rows[:20]]
    out = corpus_pipeline.STAGES[2][1](spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(x.doc_id for x in out) == list(range(30))


def signatures(text):
    value, weak, sketch = near_simhash.segments(near_simhash.sums(text)[0])
    return {(i, w, v & ~(1 << w)) for i, (v, ws) in enumerate(zip(value.tolist(), weak.tolist())) for w in ws}, sketch


def test_signatures(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b"), (3, None)], "doc_id long, text string")
    for r in near_simhash.signed(docs, "doc_id", "text").selectExpr("doc_id", f"{near_simhash.SIGNATURES} AS keys", "sketch").collect():
        keys, sketch = signatures({1: b"a b c d e f g", 2: b"a b", 3: b""}[r.doc_id])
        assert set(r.keys) == {i << 32 | w << 24 | v for i, w, v in keys} and r.sketch == sketch


def test_recall_of_similar_pairs():
    """Pairs of texts of 300 words at similarities from 0.8 on: nearly all share a signature and pass the sketch."""
    r = random.Random(8)
    words = [f"v{i}" for i in range(5000)]
    hits = total = 0
    while total < 300:
        base = [r.choice(words) for _ in range(300)]
        copy = list(base)
        for _ in range(r.randrange(1, 9)):
            copy[r.randrange(300)] = r.choice(words)
        a, b = " ".join(base).encode(), " ".join(copy).encode()
        if near_simhash.similar(near_simhash.shingles(a), near_simhash.shingles(b)):
            ka, sa = signatures(a)
            kb, sb = signatures(b)
            hits += bool(ka & kb) and ((sa ^ sb) & (1 << 64) - 1).bit_count() <= near_simhash.SKETCH
            total += 1
    assert hits >= 0.97 * total, hits / total


def test_a_hub_is_met_once_a_segment(spark):
    """Near copies share most keys of a segment; the join with the hub gives a row for the segment, and the same pairs."""
    r = random.Random(3)
    base = [r.choice("abcdefghijklmnopqrst") * r.randrange(1, 5) for _ in range(200)]
    rows = [(i, " ".join([*base[:k], f"x{i}", *base[k + 1 :]])) for i, k in enumerate(r.sample(range(200), 30))]
    node = near_simhash.signed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    members = node.selectExpr("node", "size", "sketch", f"inline({near_simhash.FORMS})").cache()
    plain = members.selectExpr("key", "node AS hub_node")
    hubs = members.groupBy("key").agg(F.max(F.struct("node", "size", "sketch", "form")).alias("hub"))
    got = near_simhash.meetings(members, hubs).selectExpr("key >> 32 AS segment", "node", "hub.node AS hub").collect()
    assert len(got) == len(set(got)) > 0
    top = max(x.node for x in node.collect())
    shared = plain.filter(plain.hub_node == top).join(members, "key").filter(f"node <> {top}").selectExpr("key >> 32 AS segment", "node", f"{top}L AS hub" if top >= 0 else f"({top}L) AS hub")
    assert {x for x in got if x.hub == top} == set(shared.collect()) and shared.count() > 1.5 * len(set(shared.collect()))


def test_rounds_make_no_row_for_each_shared_key(spark):
    """Members of one bucket in different components: finding those with company gives a row a member, and a pair that shares many
    keys is compared at the first of them only, in small buckets as in large ones."""
    r = random.Random(4)
    base = [r.choice("abcdefghijklmnopqrst") * r.randrange(1, 5) for _ in range(200)]
    rows = [(i, " ".join([*base[:k], f"x{i}", *base[k + 1 :]])) for i, k in enumerate(r.sample(range(200), 30))]
    node = near_simhash.signed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    members = node.select("node", "size", "sketch", "segments", "masks", F.col("node").alias("label"), F.explode(F.expr(near_simhash.SIGNATURES)).alias("key"), F.dense_rank().over(Window.orderBy("node")).alias("place")).cache()
    keys = {}
    for x in members.collect():
        keys.setdefault(x.node, set()).add(x.key)
    expected = {(a, b) for a in keys for b in keys if a < b and keys[a] & keys[b]}
    place = {x: i + 1 for i, x in enumerate(sorted(keys))}
    for leaders, rank in ((64, F.lit(None).cast("int")), (4, F.col("place"))):
        left = members.withColumn("rank", rank)
        wanted = {p for p in expected if leaders == 64 or min(place[x] for x in p) <= leaders}
        got = [tuple(sorted(x)) for x in near_simhash.paired(left, leaders).select("node", "b").collect()]
        assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 100
        assert {x.node for x in near_simhash.neighbours(left, leaders).collect()} == {x for p in wanted for x in p}
    assert sum(len(keys[a] & keys[b]) for a, b in expected) > 5 * len(expected)
