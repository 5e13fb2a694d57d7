"""Substring dedup against brute force over all windows."""
import random
import re

from braid.llm import substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    split = [(i, WORDS.findall(t or "")) for i, t, *_ in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, 1 << 63), (1 << 63) - 1 if i is None else i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < ((1 << 63) - 1 if i is None else i):
                gone.update(range(k, k + 13))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string").repartition(3)
    return sorted((tuple(r) for r in substring_dedup.substring_dedup(docs).collect()), key=str)


def test_against_brute_force(spark):
    r = random.Random(8)
    few, many = ["a", "b"], [f"w{i}é" for i in range(300)]
    passages = [[r.choice(many) for _ in range(r.randrange(10, 60))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(r.randrange(1, 5)):
            kind = r.random()
            if kind < 0.4:
                p = list(r.choice(passages))
                if r.random() < 0.5:
                    p[r.randrange(len(p))] = r.choice(many)
                if r.random() < 0.3:
                    p = p[r.randrange(5) :]
                words += p
            elif kind < 0.55:
                words += [r.choice(few) for _ in range(r.randrange(40))]
            elif kind < 0.65:
                words += ["x"] * r.randrange(60)
            else:
                words += [r.choice(many) for _ in range(r.randrange(30))]
        rows.append((i, r.choice([" ", "\n", " \t "]).join(words), "clash"))
    rows += [(70, None, None), (71, "", ""), (72, rows[3][1], ""), (72, rows[4][1], ""), (72, rows[4][1], ""), (None, rows[5][1], ""), (None, "only here " * 9, "")]
    assert run(spark, rows) == brute(rows)


def test_long_and_empty(spark):
    rows = [(2, "y " * 20_000, ""), (1, "z " + "y " * 30, ""), (3, "one two", "")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[2:]) == brute(rows[2:])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.substring_dedup(empty).collect() == []


def test_text_ids(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [("b", words), ("a", words + " end"), (None, words), ("c", "new " + words)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == {"a": (31, 0, words + " end"), "b": (30, 30, ""), "c": (31, 30, "new"), None: (30, 30, "")}


def test_paths_are_compacted(spark):
    """Two passages that three documents share, one of them with two ways on: each nonbranching piece is one path."""
    import pyspark.sql.functions as F

    r = random.Random(1)
    a, b, c, d = ([f"{x}{r.randrange(10**9)}" for _ in range(200)] for x in "abcd")
    rows = [(1, " ".join(a + b)), (2, " ".join(a + c)), (3, " ".join(a + b)), (4, " ".join(a + c)), (5, " ".join(d)), (6, " ".join(d))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = substring_dedup.unit_rows(substring_dedup.text_rows(docs, "doc_id", "text"))
    distinct = known.groupBy("mh", "sh").agg(F.min(F.struct("doc", "loc")).alias("s")).select("mh", "sh", "s.doc", "s.loc")
    paths = distinct.withColumn("fork", F.count("*").over(substring_dedup.Window.partitionBy("mh")) > 1)
    graph = substring_dedup.opened(substring_dedup.text_rows(docs, "doc_id", "text"), paths)
    names = substring_dedup.compacted(graph).groupBy("path").count().collect()
    assert len(names) <= 4 + sum(x.fork for x in paths.collect()) and max(x["count"] for x in names) >= 25


def test_equal_hashes_of_other_words_stay(spark, monkeypatch):
    """A stretch whose words differ from its origin's stays, whatever the hashes say."""
    span = {"start": 0, "n": 1, "digest": substring_dedup.passage([b"x"] * 13, 0, 1)}
    assert substring_dedup.covered([b"x"] * 13, [span]).all() and not substring_dedup.covered([b"x"] * 12 + [b"y"], [span]).any()
