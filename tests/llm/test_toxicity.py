"""The CRF against sums over all labellings, and toxicity on planted words."""
import itertools
import random

import numpy as np

from braid.llm import crf, toxicity


def all_paths(emit, trans, start):
    n, k = emit.shape
    for path in itertools.product(range(k), repeat=n):
        yield path, start[path[0]] + emit[range(n), path].sum() + sum(trans[a, b] for a, b in zip(path, path[1:]))


def test_crf_against_enumeration():
    r = np.random.default_rng(1)
    lengths = np.array([5, 1, 3])
    emit, trans, start = r.normal(size=(3, 5, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    marginals, total, pairs = crf.forward_backward(emit, lengths, trans, start)
    best = crf.viterbi(emit, lengths, trans, start)
    expected_pairs = np.zeros((3, 3))
    for i, n in enumerate(lengths):
        paths = list(all_paths(emit[i, :n], trans, start))
        z = sum(np.exp(s) for _, s in paths)
        assert np.isclose(total[i], np.log(z))
        m = np.zeros((n, 3))
        for p, s in paths:
            m[range(n), p] += np.exp(s) / z
            for a, b in zip(p, p[1:]):
                expected_pairs[a, b] += np.exp(s) / z
        assert np.allclose(marginals[i, :n], m)
        assert tuple(best[i, :n]) == max(paths, key=lambda x: x[1])[0]
        assert (best[i, n:] == -1).all()
    assert np.allclose(pairs, expected_pairs)


def test_gaps_equal_the_whole_chain():
    r = np.random.default_rng(2)
    model = toxicity.Model({}, r.normal(size=(2, 2)), r.normal(size=2))
    scores = [r.normal(size=n) * 2 * (r.random(n) < 0.2) for n in (1, 7, 60, 300, 40)] + [np.zeros(0), np.zeros(5), np.ones(3)]
    out, found = toxicity.summaries(model, scores)
    for s, (at, p), sums in zip(scores, out, found):
        if not len(s):
            assert not len(at)
            continue
        emit = np.stack([np.zeros(len(s)), s], axis=1)[None]
        whole = crf.forward_backward(emit, np.array([len(s)]), model.trans, model.start)[0][0, :, 1]
        assert at.tolist() == np.flatnonzero(s).tolist()
        assert np.allclose(p, whole[at], atol=1e-8)
        assert np.allclose(sums, [p.sum(), p.max() if len(p) else 0, len(s)])


def corpus(spark, path):
    r = random.Random(4)
    plain = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ane", "ori", "ule", "ist", "ano")]
    docs, labels = [], []
    for i in range(600):
        words = [r.choice(plain) for _ in range(r.randrange(5, 120))]
        toxic = i % 3 == 0
        for _ in range(3 * toxic):
            words[r.randrange(len(words))] = r.choice(["vilefool", "vilebrute", "Scoundrel!"])
        docs.append((i, " ".join(words), "en", "clash"))
        labels.append((i, int(toxic)))
    docs += [(1000, None, None, None), (1001, "", "", ""), (None, "ane", "", ""), (1002, "vilebrute " + "bane " * 50_000, "", ""), (1003, "bane " * 50_000, "", "")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, score string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels + [(9999, 1), (None, 1), (5000, None)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs, dict(labels)


def test_query_and_stage(spark, tmp_path):
    docs, labels = corpus(spark, tmp_path)
    rows = toxicity.op3_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    of = {r.doc_id: r for r in rows}
    model = toxicity.fitted(*(spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels")))
    for i, text, *_ in docs[::40] + docs[-5:]:  # the score from the whole chain, word by word
        found = [model.score(w) for w in toxicity.WORD.findall(text or "")]
        p = np.zeros(0)
        if found:
            emit = np.stack([np.zeros(len(found)), found], axis=1)[None]
            p = crf.forward_backward(emit, np.array([len(found)]), model.trans, model.start)[0][0, np.flatnonzero(found), 1]
        x = np.array([1, np.log1p(p.sum()), p.max(initial=0), np.log1p(len(found)) / 10])
        assert np.isclose(of[i].score, 1 / (1 + np.exp(-x @ model.document)), atol=1e-8)
    held = [i for i in labels if of[i].held_out]
    assert 80 < len(held) < 160
    assert np.mean([of[i].predicted == labels[i] for i in held]) > 0.98
    assert of[1002].spans[0].asDict() | {"p": 0} == {"start": 0, "end": 9, "p": 0}
    assert of[1001].predicted == of[1000].predicted == of[1003].predicted == 0
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = toxicity.stage(spark, frame, str(tmp_path))
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, none).collect()[0].predicted == 0
    assert toxicity.toxicity(docs.limit(0), none).collect() == []
