"""PDF files, entity keys of whole tables, and the catalogue's queries that have no SQL, against plain versions."""
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from braid.config import FusionConfig
from braid.operators import matching, merge
from braid.operators.entities import entity_keys
from braid.plans.fusion import fuse_records, unified
from braid.sources import api, pdf, resume

CFG = FusionConfig(as_of=2026)


def test_pdf_round_trip():
    r = random.Random(1)
    for n in (1, 3, 47, 48, 49, 200):
        lines = ["".join(r.choice("ab (\\)é–•xyz,@") for _ in range(r.randrange(1, 60))).strip() or "x" for _ in range(n)]
        pages = pdf.page_texts(pdf.pdf_of("\n".join(lines)))
        assert len(pages) == -(-n // 48) and "\n".join(pages).split("\n") == lines


def test_pdf_forms():
    """Arrays with kerning, hex strings, escapes, line operators, and a font with a ToUnicode map."""
    assert pdf.shown(b"BT 1 0 0 1 72 700 Tm [(Hel) 20 (lo) -300 (wor) 5 (ld)] TJ 0 -14 Td <4142> Tj T* (a\\051\\n\\(b) Tj (next) ' ET") == "Hello world\nAB\na)\n(b\nnext"
    cmap = b"1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <02> <04> <0062> endbfrange"
    assert pdf.shown(b"BT /F2 9 Tf (\x01\x02\x03) Tj ET", {b"F2": pdf.unicode_map(cmap)}) == "Abc"


@pytest.mark.parametrize("data", [b"", None, b"plain text", b"%PDF-1.4 nothing", pdf.pdf_of("hello")[:200], pdf.pdf_of("x" * 500).replace(b"stream\n", b"stream\nzz", 1)])
def test_pdf_that_cannot_be_read(data):
    assert pdf.text_of(data) is None or "hello" not in pdf.text_of(data)


def test_pdf_column(spark, tmp_path):
    texts = spark.createDataFrame([(1, "Ann Lee\nann@b.co"), (2, ""), (3, None)], "k int, text string")
    files = pdf.pdf_files(texts).collect()
    for row in files:
        (tmp_path / f"{row.k}.pdf").write_bytes(row.pdf)
    (tmp_path / "9.pdf").write_bytes(b"no pdf")
    got = {r.path[-5]: r.text for r in pdf.read_pdf(spark, str(tmp_path)).collect()}
    assert got == {"1": "Ann Lee\nann@b.co", "2": "", "3": "", "9": None}
    assert resume.resume_profiles(pdf.read_pdf(spark, f"{tmp_path}/1.pdf"), "path").first().email == "ann@b.co"


def plain_entities(records):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    keys = defaultdict(list)
    for i, mail, phone in records:
        if i is not None:
            root(i)
            if mail and mail.strip():
                keys["e", mail.strip().lower()].append(i)
            if phone:
                keys["p", phone].append(i)
    for members in keys.values():
        for x in members[1:]:
            a, b = sorted((root(members[0]), root(x)))
            up[b] = a
    return {x: root(x) for x in up}


def test_entity_keys(spark):
    r = random.Random(3)
    rows = [(f"r{i:03}", r.choice([f"m{r.randrange(60)}@x.co", f" M{r.randrange(60)}@X.CO", None, ""]), r.choice([f"+1415555{r.randrange(1000, 1080)}", None])) for i in range(150)]
    rows += [(f"chain{i:02}", f"c{i // 2}@x.co", f"+1628555{2000 + (i + 1) // 2}") for i in range(40)] + [(f"hot{i}", "all@x.co", None) for i in range(50)]
    rows += [("r000", "second@x.co", None), (None, "all@x.co", None), ("alone", None, None)]
    frame = spark.createDataFrame(rows, "id string, email string, phone string").repartition(4)
    got = entity_keys(frame, CFG).collect()
    assert len(got) == len({i for i, *_ in rows if i}) and {x.id: x.entity for x in got} == plain_entities(rows)
    assert entity_keys(frame.limit(0), CFG).collect() == []


def test_fuse_records(spark):
    csv = spark.createDataFrame([("Ann", "a@b.co", None), ("Bo", None, "(415) 555-2671"), ("Cy", None, None), ("Cy", None, None)], "name string, email string, phone string")
    texts = spark.createDataFrame([("t1", "Ann Lee", "A@B.co", "+14155552671")], "candidate_key string, name string, email string, phone string")
    got = {frozenset(x.sources_used): (x.full_name, x.emails, x.phones) for x in fuse_records({"csv": csv, "resume": texts}, CFG).collect()}
    assert got[frozenset(["csv", "resume"])] == ("Ann Lee", ["a@b.co"], ["+14155552671"]) and got[frozenset(["csv"])][0] == "Cy" and len(got) == 2


def test_best_entries_against_plain_rules(spark):
    r = random.Random(7)
    cases = []
    for _ in range(60):
        cases.append([(r.choice(["Dev", "dev ", "Lead", None]), r.choice(["A", "a\t", "B"]), r.choice(["2020-01", "2021-01", None]), None, r.choice([None, "x", "yy", "zz"]), str(i)) for i in range(r.randrange(12))])
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, e array<struct<title:string,company:string,start_date:string,end_date:string,description:string,source:string>>")
    for row in frame.select("i", merge.merged_experience(F.col("e")).alias("m")).collect():
        best, first = {}, {}
        for i, e in enumerate(cases[row.i]):
            k = ((e[1] or "").lower().strip(), (e[0] or "").lower().strip(), e[2] or "")
            first.setdefault(k, i)
            if k not in best or len(e[4] or "") > len(best[k][4] or ""):
                best[k] = e
        expected = sorted(best, key=lambda k: first[k])
        expected.sort(key=lambda k: k[2], reverse=True)
        assert [tuple(x) for x in row.m] == [best[k] for k in expected]


def test_languages_against_counts(spark):
    r = random.Random(2)
    cases = [[(f"r{i}", r.choice(["Go", "C", "R", "", None, "Scala"]), 1, False) for i in range(r.randrange(25))] for _ in range(60)]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, r array<struct<name:string,language:string,stargazers_count:long,fork:boolean>>")
    for row in frame.select("i", api.languages(F.col("r")).alias("x")).collect():
        used = [x[1] for x in cases[row.i] if x[1]]
        assert row.x == sorted(dict.fromkeys(used), key=lambda v: -used.count(v))


def test_conflicts_against_pairs(spark):
    r = random.Random(9)
    names = ["Ann Lee", "Lee Ann", "Bob Ray", None, ""]
    rows = [(str(k), s, r.choice(names), r.choice(["a@b.co", " A@b.co", "c@d.co", None]), r.choice(["+14155552671", "+14155552672", None])) for k in range(80) for s in ("csv", "resume", "github") if r.random() < 0.8]
    frames = {s: spark.createDataFrame([x for x in rows if x[1] == s], "candidate_key string, source string, name string, email string, phone string").drop("source") for s in ("csv", "resume", "github")}
    got = {(x.candidate_key, x.source, x.anchor_source, x.email_conflict, x.phone_conflict, x.name_conflict) for x in matching.conflicts(merge.normalized(unified(frames), CFG), CFG).collect()}
    expected = set()
    for k in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == k]
        a = own[0]
        for x in own[1:]:
            mails, phones, both = [(v or "").strip().lower() for v in (a[3], x[3])], [v or "" for v in (a[4], x[4])], [" ".join(sorted((v or "").lower().split())) for v in (a[2], x[2])]
            if all(mails) and mails[0] == mails[1] or all(phones) and phones[0] == phones[1]:
                continue
            found = (all(mails) and mails[0] != mails[1], all(phones) and phones[0] != phones[1], all(both) and both[0] != both[1])
            if any(found):
                expected.add((k, x[1], a[1], *found))
    assert got == expected
