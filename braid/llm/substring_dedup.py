"""Repeated passages: a de Bruijn graph of word k-mers, whose repeated nonbranching paths are compacted by joins and verified.

Edges are windows of 13 words, nodes are the 12 words that two windows share. Consecutive windows of a document that share their
minimizer (the least hash of the 5-word sequences inside) are one unit: a piece of path that every document cuts in the same way,
since equal windows have equal minimizers, with a fifth as many rows as windows. Joins on minimizers drop the units that no other
document can share. What is left is the graph of repeated edges: distinct units are read again at the place where they come
first, for their end nodes, and nodes with one unit in and one out connect units to longer paths. Where units of one minimizer
differ, a unit itself branches; its windows are compared one by one.

So a document's repeated words are stretches of such paths, each with the place in the earlier document that it repeats. The words
at both places are read and their SHA-256 compared before anything is removed.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from braid.llm.batches import over_texts
from braid.llm.common import documents, dropped, freed, text_or_empty, written
from braid.llm.components import components

K, M = 13, 5
#: Windows in a unit at most (4 bits of its place); only periodic text has longer runs.
UNIT = 16
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
LAST = (1 << 63) - 1
#: Names a row beside its id, so that two texts under one id stay apart.
TAG = "(xxhash64(__text) & 16777215L)"


class Powers:
    """Powers of BASE and of its inverse modulo 2 ** 64, as many as were asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int):
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            cls.up, cls.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (BASE, UNBASE))
        return cls.up[:n], cls.down[:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


class Sequence:
    """Hashes of any stretch of words, by running sums of a polynomial in BASE."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = Powers.of(len(hashes) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def units(hashes: np.ndarray, sizes: np.ndarray, k: int = K, m: int = M):
    """For documents' word hashes, one after another: document number, first window, windows, minimizer and content of each unit."""
    n = len(hashes)
    if n < k:
        return [np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]
    sequence = Sequence(hashes)
    at = np.arange(n - m + 1)
    least = sequence.of(at, at + m)
    width, span = 1, k - m + 1
    while width < span:  # least of 1, 2, 4, ... and at last span
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    document = np.repeat(np.arange(len(sizes)), sizes)
    first = (np.cumsum(sizes) - sizes)[document]
    window = np.flatnonzero(document[: n - k + 1] == document[k - 1 :])
    if not len(window):
        return units(hashes[:0], sizes[:0], k, m)
    low, doc = least[window], document[window]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])])
    run = np.flatnonzero(new)[np.cumsum(new) - 1]
    starts = np.flatnonzero((np.arange(len(window)) - run) % UNIT == 0)
    counts = np.diff(starts, append=len(window))
    where = window[starts]
    return doc[starts], where - first[where], counts, low[starts], sequence.of(where, where + counts + k - 1)


def order_id(docs: DataFrame, id_col: str):
    """An id that is never null and sorts as id_col does, null last: a long for whole numbers, else text."""
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    return F.coalesce(F.concat(F.lit("0"), F.col(id_col).cast("string")), F.lit("1"))


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(order_id(docs, id_col).alias("doc"), text_or_empty(text_col).alias("__text"))
    return rows.select("doc", F.expr(TAG).alias("tag"), "__text")


def unit_rows(rows: DataFrame) -> DataFrame:
    """(mh, sh, doc, loc) of each unit: its minimizer, its content's hash and its place: tag, first window and number of windows less 1."""

    def make():
        def f(batch):
            words = [t.split() for t in batch.column(2).cast(pa.binary()).to_pylist()]  # bytes: only ASCII white space cuts
            sizes = np.array([len(w) for w in words], np.int64)
            document, start, count, low, content = units(np.concatenate([word_hashes(w) for w in words]), sizes)
            tag = batch.column(1).to_numpy()[document]
            columns = [pa.array(low.view(np.int64)), pa.array(content.view(np.int64)), batch.column(0).take(pa.array(document)), pa.array(tag << 36 | start << 4 | count - 1)]
            return pa.RecordBatch.from_arrays(columns, ["mh", "sh", "doc", "loc"])

        return f

    return over_texts(rows, "__text", make, f"mh long, sh long, doc {doc_type(rows)}, loc long")


def doc_type(df: DataFrame) -> str:
    return df.schema["doc"].dataType.simpleString()


START, COUNT, TAG_OF = "(shiftright(loc, 4) & 4294967295L)", "cast((loc & 15) + 1 as int)", "shiftright(loc, 36)"


def at_source(rows: DataFrame, asked: DataFrame, answer, schema: str) -> DataFrame:
    """answer(asked items, the text's words) for each text that is asked for something. asked: (doc, tag, item)."""
    wanted = asked.groupBy("doc", "tag").agg(F.collect_list("item").alias("asked"))
    found = rows.join(wanted.hint("shuffle_hash"), ["doc", "tag"]).select("doc", "tag", "asked", "__text")
    names = [x.split()[0] for x in schema.split(", ")]

    def make():
        def f(batch):
            out: list[list] = [[] for _ in names]
            for doc, tag, items, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3).cast(pa.binary()).to_pylist()):
                for column, values in zip(out, answer(doc, tag, items, text.split())):
                    column.extend(values)
            kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
            return pa.RecordBatch.from_arrays([pa.array(x, kinds[k.split()[1]]) for x, k in zip(out, schema.split(", "))], names)

        return f

    return over_texts(found, "__text", make, schema)


def opened(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """paths (mh, sh, doc, loc, fork) with a, b and windows: the nodes before and after each unit, and of forked ones the hashes of
    their windows."""

    def answer(doc, tag, items, words):
        sequence = Sequence(word_hashes(words))
        loc = np.array([x["loc"] for x in items], np.int64)
        start, count = loc >> 4 & 0xFFFFFFFF, (loc & 15) + 1
        nodes = [sequence.of(x, x + K - 1).view(np.int64).tolist() for x in (start, start + count)]
        windows = [sequence.of(np.arange(s, s + n), np.arange(s, s + n) + K).view(np.int64).tolist() if x["fork"] else None for x, s, n in zip(items, start.tolist(), count.tolist())]
        return *([x[c] for x in items] for c in ("mh", "sh")), [doc] * len(items), *([x[c] for x in items] for c in ("loc", "fork")), *nodes, windows

    kind = {"bigint": "long"}.get(doc_type(rows), doc_type(rows))
    return at_source(rows, paths.select("doc", F.expr(TAG_OF).alias("tag"), F.struct("mh", "sh", "loc", "fork").alias("item")), answer, f"mh long, sh long, doc {kind}, loc long, fork boolean, a long, b long, windows array<long>")


def compacted(graph: DataFrame) -> DataFrame:
    """(mh, sh, path): the unit that names each unit's nonbranching path. graph: distinct units (mh, sh, a, b, fork, doc, loc).

    A node with one unit in and one unit out, neither forked, connects them. Most such units follow each other where they come
    first too: those runs are compacted by one sort, and the few links between runs by rounds of joins.
    """
    unit = graph.select(F.xxhash64("mh", "sh").alias("id"), "mh", "sh", "a", "b", "fork", "doc", F.expr(TAG_OF).alias("tag"), F.expr(START).alias("start"), F.expr(COUNT).alias("n"))
    unit = written(unit, "units")
    end = unit.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n_in"), F.max("id").alias("u"), F.max("fork").alias("fork_u")).filter("n_in = 1 AND NOT fork_u")
    begin = unit.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_out"), F.max("id").alias("v"), F.max("fork").alias("fork_v")).filter("n_out = 1 AND NOT fork_v")
    links = written(end.join(begin, "node").select("u", "v").filter("u <> v"), "links")
    freed(graph.sparkSession)
    order = Window.partitionBy("doc", "tag").orderBy("start", "id")
    follows = (F.lag("id").over(order) == F.col("u")) & (F.lag(F.col("start") + F.col("n")).over(order) == F.col("start"))
    runs = unit.join(links.select("u", F.col("v").alias("id")), "id", "left").withColumn("head", F.when(F.coalesce(follows, F.lit(False)), None).otherwise(F.col("id")))
    runs = written(runs.withColumn("head", F.last("head", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).select("id", "mh", "sh", "u", "head"), "runs")
    for t in (unit, links):
        dropped(t)
    freed(graph.sparkSession)
    # links whose run goes on are within it; the others connect two runs
    outer = runs.filter("u IS NOT NULL AND head = id").select("u", F.col("head").alias("b")).join(runs.select(F.col("id").alias("u"), F.col("head").alias("a")), "u").filter("a <> b").select("a", "b")
    names = components(outer)
    out = written(runs.join(names.withColumnRenamed("node", "head"), "head", "left").select("mh", "sh", F.coalesce("label", "head").alias("path")), "compacted")
    dropped(runs)
    return out


def repeats(rows: DataFrame) -> DataFrame:
    """(doc, tag, spans array<struct<start, n, digest>>): stretches of n windows that repeat an earlier document's, and the SHA-256
    of their words there.

    Tables of the steps are written and dropped as soon as the next one stands, so the disk holds one step's exchange at a time.
    """
    spark = rows.sparkSession
    edges = written(unit_rows(rows), "edges")
    shared = written(edges.groupBy("mh").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("mh", "first"), "shared")
    freed(spark)
    # a unit of the first document that holds its minimizer repeats nothing, but others may repeat it
    known = written(edges.join(shared, "mh"), "known")
    dropped(edges)
    dropped(shared)
    freed(spark)
    distinct = written(known.groupBy("mh", "sh").agg(F.min(F.struct("doc", "loc")).alias("source")).select("mh", "sh", "source.doc", "source.loc"), "distinct")
    forks = distinct.groupBy("mh").agg(F.count("*").alias("n")).select("mh", (F.col("n") > 1).alias("fork"))
    paths = written(distinct.join(forks, "mh"), "paths")
    dropped(distinct)
    freed(spark)
    graph = written(opened(rows, paths), "graph")
    dropped(paths)
    freed(spark)
    names = compacted(graph)
    # of forked units, the windows that an earlier document has, each with its place there
    place = F.struct("doc", F.expr(TAG_OF).alias("tag"), (F.expr(START) + F.col("i")).alias("start"))
    windows = written(graph.filter("fork").select("mh", "sh", "doc", "loc", F.posexplode("windows").alias("i", "wh")).select("mh", "sh", "doc", "i", "wh", place.alias("place")), "windows")
    earliest = written(windows.groupBy("mh", "wh").agg(F.min("place").alias("origin"), F.max("doc").alias("latest")).filter("origin.doc < latest").select("mh", "wh", "origin"), "earliest")
    partly = windows.join(earliest, ["mh", "wh"]).filter("origin.doc < doc").groupBy("mh", "sh").agg(F.collect_list(F.struct("i", "origin")).alias("partly"))  # 16 at most
    origin = F.struct("doc", F.expr(TAG_OF).alias("tag"), F.expr(START).alias("start"))
    freed(spark)
    sources = written(graph.select("mh", "sh", origin.alias("origin")).join(names, ["mh", "sh"]).join(partly, ["mh", "sh"], "left"), "sources")
    for t in (graph, names, windows, earliest):
        dropped(t)
    freed(spark)
    later = known.filter("doc > first").join(sources, ["mh", "sh"]).select("doc", F.expr(TAG_OF).alias("tag"), F.expr(START).alias("start"), F.expr(COUNT).alias("n"), "path", "origin", "partly")
    whole = later.filter("origin.doc < doc").select("doc", "tag", "start", "n", "path", "origin")
    pieces = later.filter("origin.doc >= doc AND partly IS NOT NULL").select("doc", "tag", "start", F.explode("partly").alias("x"))
    pieces = pieces.select("doc", "tag", (F.col("start") + F.col("x.i")).alias("start"), F.lit(1).alias("n"), F.lit(None).cast("long").alias("path"), F.col("x.origin").alias("origin"))
    # stretches: units of one path that follow each other here as at their origin, or windows of forked units that do
    every = whole.union(pieces).select("doc", "tag", "start", "n", "path", F.col("origin.doc").alias("src"), F.col("origin.tag").alias("src_tag"), (F.col("start") - F.col("origin.start")).alias("shift"))
    key = ["doc", "tag", "src", "src_tag", "shift", "path"]
    along = Window.partitionBy(*key).orderBy("start")
    new = F.when(F.lag(F.col("start") + F.col("n")).over(along) >= F.col("start"), 0).otherwise(1)
    stretch = every.withColumn("new", new).withColumn("k", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    long = stretch.groupBy(*key, "k").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"))
    long = written(long.select("doc", "tag", "src", "src_tag", "start", (F.col("start") - F.col("shift")).alias("src_start"), (F.col("end") - F.col("start")).alias("n")), "long")
    for t in (known, sources):
        dropped(t)
    freed(spark)
    at = ["src", "src_tag", "src_start", "n"]
    asked = long.select(*at).distinct().select(F.col("src").alias("doc"), F.col("src_tag").alias("tag"), F.struct("src_start", "n").alias("item"))

    def answer(doc, tag, items, words):
        return [doc] * len(items), [tag] * len(items), [x["src_start"] for x in items], [x["n"] for x in items], [passage(words, x["src_start"], x["n"]) for x in items]

    kind = {"bigint": "long"}.get(doc_type(rows), doc_type(rows))
    digests = written(at_source(rows, asked, answer, f"src {kind}, src_tag long, src_start long, n long, digest binary"), "digests")
    freed(spark)
    told = long.join(digests.hint("merge"), at)
    out = written(told.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n", "digest")).alias("spans")), "spans")
    for t in (long, digests):
        dropped(t)
    freed(spark)
    return out


def passage(words: list[bytes], start: int, n: int) -> bytes:
    """The SHA-256 of the words of n windows."""
    return hashlib.sha256(b" ".join(words[start : start + n + K - 1])).digest()


def covered(words: list[bytes], spans: list[dict]) -> np.ndarray:
    """Which words lie in the spans' windows; only spans whose words are those of their origin count."""
    edge = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        if passage(words, s["start"], s["n"]) == s["digest"]:
            edge[s["start"]] += 1
            edge[min(s["start"] + s["n"] + K - 1, len(words))] -= 1
    return np.cumsum(edge[:-1]) > 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a window of 13 words that covers it also starts in a document of a smaller id, judged on the input. Words are
    runs without ASCII white space; null texts have none. Ids are whole numbers, or else sort as text. Rows that repeat an id don't
    repeat each other; null ids come last and repeat only what others have. Texts of fewer than 13 words stay whole, texts of any
    length count whole. Candidates are found by 128 bits of hashes and removed if the SHA-256 of the words is equal. Empty tables
    give empty results.
    """
    spans = repeats(text_rows(docs, id_col, text_col))
    rows = docs.select(F.col(id_col).alias("__id"), order_id(docs, id_col).alias("doc"), text_or_empty(text_col).alias("__text"))
    joined = rows.withColumn("tag", F.expr(TAG)).join(spans.hint("shuffle_hash"), ["doc", "tag"], "left").select("__id", "spans", "__text")

    def make():
        def f(batch):
            n_words, n_removed, kept = [], [], []
            for spans, text in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                words = text.split()
                n_words.append(len(words))
                if spans:
                    stays = (~covered(words, spans)).tolist()
                    words = [w for w, s in zip(words, stays) if s]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [id_col, "n_words", "n_removed", "kept_text"])

        return f

    return over_texts(joined, "__text", make, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_words long, n_removed long, kept_text string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM split)),
firsts AS (SELECT k, min(doc_id) AS earliest FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM windows JOIN firsts USING (k) WHERE earliest < doc_id),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM split),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
  FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.words) AS BIGINT) AS n_words, CAST(len(s.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)
"""
