"""SimHash against brute force: fingerprints by definition, links by all pairs, components by search."""
import random

import pytest
import xxhash

from braid.llm import simhash
from braid.llm.components import components


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps):
    out = {}
    for start in range(len(ids)):
        seen, todo = {start}, [start]
        while todo:
            i = todo.pop()
            for j in range(len(ids)):
                if j not in seen and (fps[i] ^ fps[j]).bit_count() <= 3:
                    seen.add(j)
                    todo.append(j)
        out[start] = min(ids[i] for i in seen)
    return out


def test_query(spark, tmp_path):
    r = random.Random(3)
    vocabulary = [f"w{i}É" for i in range(400)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 40, 200]))) for _ in range(80)]
    for _ in range(60):
        words = r.choice(texts).split(" ")
        for _ in range(r.choice([0, 1, 2])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append("\n".join(words).upper() if r.random() < 0.2 else " ".join(words))
    texts += [None, "", " \t", "A b C", "a B c"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in simhash.op5_simhash(spark, str(tmp_path)).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    expected = slow_components(list(range(len(texts))), fps)
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[i].fingerprint == f"{fps[i]:016x}"
        assert got[i].component_id == expected[i]


@pytest.mark.parametrize("bucket", [2, 5, 2048])
def test_links_in_crowded_buckets(spark, bucket):
    r = random.Random(bucket)
    base = r.getrandbits(64)
    fps = {base}
    while len(fps) < 150:
        fp = r.choice(list(fps))
        for _ in range(r.choice([1, 2, 3, 6])):
            fp ^= 1 << r.randrange(64)
        fps.add(fp)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = simhash.links(frame, bucket=bucket).collect()
    labels = {x.node: x.label for x in components(spark.createDataFrame(found, "a long, b long")).collect()} if found else {}
    expected = slow_components(list(range(len(fps))), fps)
    groups = {}
    for i, s in enumerate(signed):
        groups.setdefault(labels.get(s, s), set()).add(expected[i])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(expected.values()))


def test_components(spark):
    path = [(i, i + 1) for i in range(100)]
    other = [(1000, 1001), (1001, 1000), (7000, 7000)]
    got = {r.node: r.label for r in components(spark.createDataFrame(path + other, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {1000: 1000, 1001: 1000, 7000: 7000}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(docs).collect() == []
