"""Exact dedup, line dedup, mixing and licences against plain Python, with nulls, ties, repeated rows and empty tables."""
import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from braid.llm import exact_dedup, licenses, line_dedup, mixing

SCHEMA = "doc_id long, text string, source string, kept string, bitmap int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 1) for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    texts = ["a", "A", "b\nc", "b\r\nc ", "", None, "ß", "x " * 5000] + [f"t{i}\ncommon line\n{'rare' * i}" for i in range(20)]
    out = [(i, r.choice(texts), r.choice(["s1", "s2", "s10", "é", None, ""])) for i in range(150)]
    return out + [(500, "dup", "s1"), (500, "dup", "s1"), (500, "other", "s1"), (None, "lone", "s1"), (None, None, None)]


def test_exact_dedup(spark, rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    for keep, best in (("max", max), ("min", min)):
        for levels in (None, 1, 3):
            got = exact_dedup.exact_dedup(frame(spark, rows), keep=keep, levels=levels).collect()
            assert len(got) == len(rows)
            expected = Counter()
            for i, t, _ in rows:
                ids = [x for x in groups[t or ""] if x is not None]
                top = best(ids) if ids else None
                expected[(i, top, len(groups[t or ""]), i == top, hashlib.sha256((t or "").encode()).hexdigest())] += 1
            assert Counter(map(tuple, got)) == expected
    assert exact_dedup.exact_dedup(frame(spark, rows).limit(0)).collect() == []


def test_exact_dedup_merges_sorted_runs(spark, rows):
    plan = exact_dedup.exact_dedup(frame(spark, rows), levels=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate(key=[run") == 6 and plan.count("REPARTITION_BY_COL") == 3


@pytest.mark.parametrize("min_docs", [1, 2, 10])
def test_line_dedup(spark, rows, min_docs):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    rows = [*rows, (600, "\n".join(f"line {n % 90} {'y' * (n % 2)}" for n in range(200)), "s"), *((601 + i, "Line 7 \nend\n\n", "s") for i in range(12))]
    docs = Counter()
    for t in {(i, t or "") for i, t, _ in rows}:
        docs.update({key(x) for x in t[1].split("\n")} - {""})
    expected = Counter()
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if docs[key(x)] < min_docs]
        expected[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    for limit in (0, line_dedup.BROADCAST_BYTES):
        got = line_dedup.line_dedup(frame(spark, rows), min_docs=min_docs, limit=limit).collect()
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == expected
        for r in got:
            masks = {w.word: w.mask for w in r.bitmap or []}
            kept = [masks.get(p // 63, -1) >> p % 63 & 1 for p in range(r.n_lines)]
            assert kept.count(0) == r.n_dropped and (r.bitmap is None) == (r.n_dropped == 0)
    assert line_dedup.line_dedup(frame(spark, rows).limit(0)).collect() == []


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full, target = sum(sizes.values()), {}, {}
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(full.values())
        target = full | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3.0 * sizes[s] for s in free if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randrange(1, 4) for _ in range(r.randrange(60))) or None, r.choice(["hot"] * 6 + ["b", "c", "Z", "é", "", None])) for i in range(300)]
    rows += [(900, "a b", "b"), (900, "a b", "b"), (None, "a b c", "c"), (901, " \t\n", "empty only")]
    got = mixing.mix(frame(spark, rows))
    table = got.collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    expected = plain_targets(sizes)
    assert len(table) == len(rows)
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for x in table:
        s = source[x.doc_id]
        assert x.source_size == sizes[s]
        assert abs(x.target - expected[s]) < 1e-6
        assert 0 <= x.taken <= 3 * x.size
        assert (x.position is None) == (x.taken == 0) and 0 <= (x.position or 0) <= 1
        taken[s] += x.taken
    for s in sizes:
        assert expected[s] - 1 - 1e-6 <= taken[s] <= expected[s] + 1e-6
    placed = [x.position for x in table if x.position is not None]
    assert placed == sorted(placed)
    assert sorted(map(str, mixing.mix(frame(spark, rows).repartition(5)).collect())) == sorted(map(str, table))
    docs = frame(spark, rows)
    copies = Counter(x.doc_id for x in mixing.stage(spark, docs, "").collect())
    size = {i: len((t or "").split()) for i, t, _ in rows}
    for x in table:
        if x.doc_id not in (900,):
            assert copies[x.doc_id] == (1 if not size[x.doc_id] else (2 * x.taken + x.size) // (2 * x.size))
    assert mixing.mix(docs.limit(0)).collect() == []


def test_schedules():
    for schedule in mixing.SCHEDULES:
        sums = mixing.integral(schedule)
        assert sums[0] == 0 and sums == sorted(sums)


def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    variants = ["MIT License\n"[:0] + "Copyright (c) 2020 A. Author\n\n" + mit, mit.upper().replace(",", " ;"), "© 2001 Someone, all rights\n" + mit.replace("sublicense", "sub-licence"), "# " + mit.replace("\n", "\n# ")]
    rows = [(i, t, None) for i, t in enumerate([*variants, mit + " more", "", None, "Released under the MIT Licence"])]
    got = {r.doc_id: r.license for r in licenses.license_scan(frame(spark, rows)).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: None, 6: None, 7: "MIT"}
    assert licenses.license_scan(frame(spark, rows).limit(0)).collect() == []


def test_licenses_as_published(spark):
    mit = licenses.KNOWN[0][1]
    whole = {f.stem: f.read_text(encoding="utf-8") for f in (Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
    notice = "Copyright (c) 2020 A. Author\n\n"
    cases = [("MIT", "MIT License\n\n" + notice + mit), ("MIT", "The MIT License (MIT)\n\n" + notice + mit), ("ISC", "ISC License\n\n" + notice + licenses.KNOWN[1][1]), ("Zlib", "zlib License\n\n" + notice + licenses.KNOWN[2][1])]
    cases += [*whole.items(), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + notice + whole["BSD-3-Clause"])]
    two = whole["BSD-3-Clause"].split("3. Neither")[0] + "THIS SOFTWARE" + whole["BSD-3-Clause"].split("THIS SOFTWARE", 1)[1]
    cases += [("BSD-2-Clause", "BSD 2-Clause License\n\n" + notice + two), ("Apache-2.0", whole["Apache-2.0"].split("   APPENDIX")[0])]
    cases += [("GPL-3.0-only", whole["GPL-3.0-only"].split("29 June 2007", 1)[1]), (None, whole["GPL-3.0-only"][:-2000]), (None, "MIT License"), (None, "MIT License\n\n" + two)]
    got = {r.doc_id: r.license for r in licenses.license_scan(frame(spark, [(i, t, None) for i, (_, t) in enumerate(cases)])).collect()}
    assert [got[i] for i in range(len(cases))] == [name for name, _ in cases]


def test_mixing_passes(spark):
    """Every pass has its position, and the stage's copies stand in their order."""
    rows = [(i, "w " * (i % 7 + 1), "abc"[i % 3] if i % 5 else "a") for i in range(90)]
    table = mixing.mix(frame(spark, rows), positions=True).collect()
    assert max(len(x.positions) for x in table) > 1
    for x in table:
        assert len(x.positions) == -(-x.taken // x.size) and x.positions == sorted(x.positions)
        assert x.position == (x.positions[0] if x.positions else None)
    copies = {x.doc_id: (2 * x.taken + x.size) // (2 * x.size) for x in table}
    order = sorted((p, x.doc_id) for x in table for p in x.positions[: copies[x.doc_id]])
    assert [x.doc_id for x in mixing.stage(spark, frame(spark, rows), "").collect()] == [i for _, i in order]
