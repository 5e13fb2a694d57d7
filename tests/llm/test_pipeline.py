"""The pipeline against a plain version of each stage, on a small corpus with planted cases."""
import random
from collections import Counter

import corpus_pipeline
from braid.llm import bpe, mixing, near_simhash, toxicity


def test_pipeline(spark, tmp_path):
    r = random.Random(2)
    plain = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ane", "ori", "ule", "ist", "ano")]
    docs, labels = [], []
    for i in range(400):
        words = [r.choice(plain) for _ in range(r.randrange(30, 90))]
        toxic = i % 4 == 0
        for _ in range(4 * toxic):
            words[r.randrange(len(words))] = r.choice(["vilefool", "vilebrute"])
        docs.append((i, " ".join(words), "en", r.choice(["s1", "s1", "s2", "s3", None]), len(words)))
        labels.append((i, 0, int(toxic)))
    clean = [d for d in docs if d[0] % 4]
    docs += [(1000 + k, clean[k][1], "en", "s1", 1) for k in range(20)] + [(2000 + k, clean[k][1] + ".", "en", "s2", 1) for k in range(20, 40)]
    docs += [(3000, "", "en", "s1", 0), (3001, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = str(tmp_path)

    frame = spark.read.parquet(f"{d}/documents.parquet")
    tables = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = spark.createDataFrame(stage(spark, frame, d).collect(), schema)
        tables.append({"name": name, "rows": frame.collect()})
    scores = {x.doc_id: x.predicted for x in toxicity.op3_toxicity(spark, d).collect()}
    kept = [x for x in docs if not scores[x[0]]]
    assert sorted(x.doc_id for x in tables[0]["rows"]) == sorted(x[0] for x in kept)
    assert sum(x[0] % 4 == 0 for x in kept if x[0] < 400) <= 2 and sum(x[0] % 4 > 0 for x in kept if x[0] < 400) >= 298
    last = {}
    for x in kept:
        last[x[1] or ""] = max(last.get(x[1] or "", -1), x[0])
    assert sorted(x.doc_id for x in tables[1]["rows"]) == sorted(last.values())
    ids = sorted(last.values())
    text = {x[0]: x[1] or "" for x in docs}
    sets = {i: near_simhash.shingles(text[i].encode()) for i in ids}
    left = []
    for i in ids:  # least ids first: a document goes if a chain of similar texts reaches a smaller id
        seen, todo = {i}, [i]
        while todo:
            a = todo.pop()
            more = [b for b in ids if b not in seen and (not sets[a] | sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)]
            seen.update(more)
            todo += more
        if min(seen) == i:
            left.append(i)
    assert sorted(x.doc_id for x in tables[2]["rows"]) == left
    mixed = {x.doc_id: x for x in mixing.mix(spark.createDataFrame(tables[2]["rows"], schema)).collect()}
    copies = Counter(x.doc_id for x in tables[3]["rows"])
    assert copies == Counter({i: (1 if not m.size else (2 * m.taken + m.size) // (2 * m.size)) for i, m in mixed.items()}) - Counter()

    out = corpus_pipeline.run(spark, d).collect()
    assert Counter(x.doc_id for x in out) == copies
    file, pattern = bpe.rank_file()
    for x in out[:40]:
        assert list(x.ids) == bpe.Encoder(file, pattern).encode([text[x.doc_id]])[0].tolist() and x.n_tokens == len(x.ids)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_edges(spark, tmp_path):
    """Empty tables, nulls in every column, repeated ids and rows, and columns with the stages' own names."""
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    clean = [(i, " ".join(words[i % 5 :] + [f"w{i}{k}" for k in range(20)]), "en", ["s", "t", None][i % 3], 1) for i in range(40)]
    toxic = [(100 + i, " ".join(words[i % 7 :] + ["vilefool"] * 4 + [f"x{i}{k}" for k in range(20)]), "en", "s", 1) for i in range(40)]
    rows = clean + toxic + [(None, None, None, None, None), (3, clean[3][1], "en", "s", 1), (3, "another text under that id", None, None, None), (200, "", "", "", 0), clean[5]]
    spark.createDataFrame([(r[0], int(r[0] >= 100)) for r in clean + toxic], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    extra = ("__keep", "__id", "__mix", "__position", "label", "node", "size", "score")
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in extra])
    frame, empty = docs, docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = spark.createDataFrame(stage(spark, frame, str(tmp_path)).collect(), docs.schema)
        kept = frame.collect()
        assert frame.columns == docs.columns and {r.doc_id for r in kept} <= {r[0] for r in rows}, name
        assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in kept for c in extra), name
        assert stage(spark, empty, str(tmp_path)).collect() == [], name
    ids = Counter(r.doc_id for r in kept)
    assert not set(ids) & {r[0] for r in toxic} and len(set(ids) & set(range(40))) >= 30
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).collect() == []
    assert Counter(r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).collect()) == ids
