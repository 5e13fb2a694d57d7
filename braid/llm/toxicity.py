"""Toxicity: a two-label linear-chain CRF over words, and document scores from its marginals.

The labelled rows mark documents, the CRF needs marked words. Words' labels are estimated in turns with the chain, from first ones
that features give (the word itself, or how it begins) which are far more frequent in toxic documents than in others; see train().
Near copies among the labelled rows count once, so that a copied document's plain words don't qualify.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.llm import crf
from braid.llm.batches import over_texts
from braid.llm.common import documents, text_or_empty

#: The model is fitted on so many labelled documents of each class at most, the first by a hash of their ids, and only on
#: documents of up to so many bytes. Scores are for all documents and whole texts.
TRAIN_DOCS, TRAIN_BYTES = 2500, 32_000
#: Bounds of the fit besides: features; the words of a training sequence; training sequences with and without a word that has a
#: feature. Beyond the last two, every so many-th sequence is taken.
FEATURES, WINDOW, MARKED_WINDOWS, CLEAN_WINDOWS = 4000, 40, 4000, 2000
#: A feature is used from so many toxic documents and such a log ratio of document frequencies on; from SEED_RATIO on it labels
#: tokens in the first turn.
LEAST_DOCS, LEAST_RATIO, SEED_RATIO = 4, 1.5, 2.5
#: Turns of fitting and labelling; a toxic document without a toxic word gets its likeliest one from this marginal on.
TURNS, LEAST_MARGINAL = 3, 0.05
#: Smaller weights are 0, so that most words have no score.
LEAST_WEIGHT = 0.2
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
SLOTS = 1 + len(PREFIXES)


def features(word: str) -> list[str]:
    word = word.lower()
    return [word + "$", *(word[:n] for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    """score(word) is how much its features favour toxic over clean; 0 where it has none of the model's."""

    weights: dict[str, float] = field(default_factory=dict)
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    document: np.ndarray = field(default_factory=lambda: np.array([-2.2, 0, 0, 0]))

    def score(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))


class Words(dict):
    """Numbers of words in lower case, so that documents are small arrays while a model is fitted."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n

    def array(self, text: str) -> np.ndarray:
        return np.fromiter((self[w.lower()] for w in WORD.findall(text)), np.int32)


def distinct_texts(rows: list[tuple[str, int]], words: Words) -> list[tuple[np.ndarray, int]]:
    """The words of each text, without texts half of whose sampled shingles stand in earlier ones."""
    out, seen = [], set()
    for text, label in rows:
        ids = words.array(text)
        mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        sums = sum((mixed[k : len(ids) - 3 + k] * np.uint64(2 * k + 1) for k in range(4)), np.zeros(max(0, len(ids) - 3), np.uint64)) if len(ids) > 3 else np.empty(0, np.uint64)
        shingles = set(sums[sums >> np.uint64(61) == 0].tolist()) or {hash(ids.tobytes())}
        if 2 * len(shingles & seen) < len(shingles):
            out.append((ids, label))
        seen |= shingles
    return out


def chosen(docs: list[tuple[np.ndarray, int]], names: list[str]) -> dict[str, float]:
    """Features and their log ratios. Only features of enough toxic documents are counted in the others."""
    totals, counts = [1, 1], (Counter(), Counter())
    for label in (1, 0):
        for ids, own in docs:
            if own == label:
                totals[label] += 1
                found = {f for i in np.unique(ids).tolist() for f in features(names[i])}
                counts[label].update(found if label else found & counts[1].keys())
        if label:
            for f in [f for f, n in counts[1].items() if n < LEAST_DOCS]:
                del counts[1][f]
    ratios = {f: math.log((n + 0.5) / totals[1]) - math.log((counts[0][f] + 0.5) / totals[0]) for f, n in counts[1].items()}
    best = sorted((f for f, r in ratios.items() if r >= LEAST_RATIO), key=lambda f: (-ratios[f] * math.log(counts[1][f] + 1), f))
    return {f: ratios[f] for f in best[:FEATURES]}


def train(rows: list[tuple[str, int]], base_rate: float) -> Model:
    """rows: (text, label). Without rows of both classes the score is the base rate.

    Token labels are estimated in turns with the chain: a toxic document's words start as toxic where a feature's ratio is high;
    then each turn fits the chain to the labels and labels again, by the chain's marginals: words over one half, and in a toxic
    document without any its likeliest word. Clean documents' words are clean throughout.
    """
    model = Model()
    odds = math.log(max(base_rate, 1e-3) / max(1 - base_rate, 1e-3))
    model.document = np.array([odds, 0, 0, 0])
    words = Words()
    docs = distinct_texts(rows, words)
    names = list(words)
    ratios = chosen(docs, names)
    if not ratios:
        return model
    numbers = {f: i for i, f in enumerate(ratios, 1)}
    ratio = np.array([0.0, *ratios.values()])
    slots = np.zeros((len(names), SLOTS), np.int32)
    for i, name in enumerate(names):
        own = [numbers.get(f, 0) for f in features(name)]
        slots[i, : len(own)] = own
    has = slots.any(axis=1)
    seed = ratio[slots].max(axis=1) >= SEED_RATIO
    tags = [seed[ids] & (label == 1) for ids, label in docs]
    # training sequences: those with a word of some feature, and one without from each document, in turn from all of its places
    marked, clean = [], []
    for d, (ids, _) in enumerate(docs):
        starts = range(0, len(ids), WINDOW)
        with_mark = [(d, i) for i in starts if has[ids[i : i + WINDOW]].any()]
        marked += with_mark
        rest = sorted({(d, i) for i in starts} - set(with_mark))
        clean += rest[len(clean) % len(rest) :][:1] if rest else []
    parts = marked[:: -(-len(marked) // MARKED_WINDOWS) or 1] + clean[:: -(-len(clean) // CLEAN_WINDOWS) or 1]
    lengths = np.array([len(docs[d][0][i : i + WINDOW]) for d, i in parts], np.int64)
    x, y = np.zeros((len(parts), WINDOW, SLOTS), np.int32), np.zeros((len(parts), WINDOW), np.int64)
    for row, (d, i) in enumerate(parts):
        x[row, : lengths[row]] = slots[docs[d][0][i : i + WINDOW]]
    labels = np.array([label for _, label in docs])
    for turn in range(TURNS):
        for row, (d, i) in enumerate(parts):
            y[row, : lengths[row]] = tags[d][i : i + WINDOW]
        w, model.trans, model.start = crf.fit(x, y, lengths, len(numbers) + 1, 2, rounds=40, l2=2e-4)
        delta = w[:, 1] - w[:, 0]
        delta[np.abs(delta) <= LEAST_WEIGHT] = 0
        by_word = delta[slots].sum(axis=1)
        per_word, found = summaries(model, [by_word[ids] for ids, _ in docs])
        for d in np.flatnonzero(labels):
            at, p = per_word[d]
            tags[d] = np.zeros(len(docs[d][0]), bool)
            if len(p):
                tags[d][at[(p >= 0.5) | (p >= p.max()) & (p.max() >= LEAST_MARGINAL)]] = True
    model.weights = {f: float(delta[i]) for f, i in numbers.items() if delta[i]}
    model.document = logistic(evidence(found), labels, np.where(labels == 1, base_rate / max(labels.mean(), 1e-9), (1 - base_rate) / max(1 - labels.mean(), 1e-9)))
    return model


def evidence(found: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(found)), np.log1p(found[:, 0]), found[:, 1], np.log1p(found[:, 2]) / 10], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, l2: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method."""
    b = np.zeros(x.shape[1])
    ridge = l2 * np.diag([0.01, *[1.0] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ b)
        b = b + np.clip(step, -2, 2)
    return b


def summaries(model: Model, scores: list) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each document's word scores: positions and toxic marginals of the words that have a score, and their sum and largest and
    the number of words.

    Words without a score all have the same transition matrix, so a gap of g of them is its g-th power, which has a closed form:
    the forward and backward passes step from scored word to scored word, over all documents at once, and are those of the whole
    chain. Words without a score aren't toxic by definition.
    """
    where = [np.flatnonzero(s) for s in map(np.asarray, scores)]
    lengths = np.array([len(s) for s in scores], np.int64)
    found = np.zeros((len(scores), 3))
    found[:, 2] = lengths
    out = [(w, np.empty(0)) for w in where]
    docs = np.array([i for i, w in enumerate(where) if len(w)], np.int64)
    docs = docs[np.argsort([len(where[i]) for i in docs], kind="stable")]
    for part in np.array_split(docs, -(-len(docs) // 256)) if len(docs) else []:
        n = np.array([len(where[i]) for i in part])
        wide = int(n.max())
        gaps, emit = np.zeros((len(part), wide + 1), np.int64), np.zeros((len(part), wide))
        for row, i in enumerate(part):
            at = where[i]
            gaps[row, : len(at)] = np.diff(at, prepend=-1) - 1
            gaps[row, len(at)] = lengths[i] - 1 - at[-1]
            emit[row, : len(at)] = np.asarray(scores[i])[at]
        p = marginals(model, gaps, emit, n)
        for row, i in enumerate(part):
            out[i] = where[i], p[row, : n[row]]
            found[i, :2] = p[row, : n[row]].sum(), p[row, : n[row]].max()
    return out, found


def powers(m: np.ndarray, g: np.ndarray) -> np.ndarray:
    """m ** g for 2 x 2 positive m, divided by its larger eigenvalue ** g."""
    half, det = (m[0, 0] + m[1, 1]) / 2, m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0]
    root = math.sqrt(max(half * half - det, 1e-300))
    ratio = (half - root) / (half + root)
    big = (m - (half - root) * np.eye(2)) / (2 * root)
    return big + (ratio ** g)[..., None, None] * (np.eye(2) - big)


def marginals(model: Model, gaps: np.ndarray, emit: np.ndarray, n: np.ndarray) -> np.ndarray:
    m = np.exp(model.trans - model.trans.max())
    start = np.exp(model.start - model.start.max())
    rows, wide = emit.shape
    step = powers(m, gaps)
    lift = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -50, 50))], axis=2)
    forward, backward = np.empty((rows, wide, 2)), np.ones((rows, wide, 2))
    now = None
    for t in range(wide):
        # the first word takes start; each later one a transition after the gap's
        now = np.einsum("i,rij->rj", start, step[:, 0]) if t == 0 else np.einsum("ri,rij,jk->rk", now, step[:, t], m)
        now = now * lift[:, t]
        now /= now.sum(axis=1, keepdims=True)
        forward[:, t] = now
    after = np.ones((rows, 2))
    for t in range(wide - 1, -1, -1):
        inner = np.einsum("rij,rj->ri", step[:, t + 1], np.einsum("ij,rj->ri", m, lift[:, t + 1] * after)) if t + 1 < wide else after
        last = step[np.arange(rows), n].sum(axis=2)
        after = np.where((t == n - 1)[:, None], last, inner)
        after /= after.sum(axis=1, keepdims=True)
        backward[:, t] = after
    both = forward * backward
    return both[..., 1] / both.sum(axis=2)


class Scores(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        score = self.model.score(word)
        if len(self) > 200_000:
            self.clear()
        self[word] = score
        return score


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id_col, score, spans array<struct<start, end, p>>) for each row: spans are the words, in code points, whose marginal
    reaches the threshold. Null and empty texts have no words and get the score that this gives. Whole texts; nothing is shuffled."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def make():
        of = Scores(model).__getitem__

        def f(batch):
            texts = batch.column(1).to_pylist()
            per_word, found = summaries(model, [np.array(list(map(of, WORD.findall(t)))) for t in texts])
            score = 1 / (1 + np.exp(-(evidence(found) @ model.document)))
            spans = []
            for t, (at, p) in zip(texts, per_word):
                hits = {int(i): float(x) for i, x in zip(at, p) if x >= threshold}
                spans.append([{"start": m.start(), "end": m.end(), "p": hits[i]} for i, m in enumerate(WORD.finditer(t)) if i in hits] if hits else [])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(spans, kind)], [id_col, "score", "spans"])

        return f

    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("__text"))
    return over_texts(rows, "__text", make, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, score double, spans array<struct<start:int,end:int,p:double>>")


def held_out(col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> Model:
    """A model of at most `limit` labelled documents of each class that aren't held out, the first by a hash of their ids."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "toxic")
    counts = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    first = [usable.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for k in (0, 1)]
    picked = first[0].union(first[1])  # at most 2 * limit rows, so it is broadcast
    rows = (
        docs.filter(F.octet_length("text") <= TRAIN_BYTES)
        .select("doc_id", "text")
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(2 * limit)
        .collect()
    )
    return train([(r.text, int(r.toxic)) for r in rows], counts.get(1, 0) / max(1, sum(counts.values())))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, spans. See fitted() and scored().

    Rows are scored one by one, so repeated rows get equal rows, null ids stay (never held out, never used for the fit), and equal
    scores don't matter. Without usable labels of both classes every score is the base rate. Empty tables give empty results.
    """
    out = scored(docs, fitted(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the model calls toxic. Scores ride on each row's own columns, so rows that repeat an id are
    judged each by its own text, and nothing is shuffled."""
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    return scored(whole, model, id_col="row").filter("score < 0.5").select("row.*")
