"""The engine on frames: scalar functions, matching, merge, confidence, projection, sources, and one candidate end to end."""
import json
import random

import pytest
from pyspark.sql import functions as F

import fixtures
from braid.__main__ import main
from braid.config import FusionConfig
from braid.functions import scalars as S
from braid.operators import matching, merge, projection, validation
from braid.plans.fusion import fuse, run, unified
from braid.schema import SOURCE_PROFILE, aligned
from braid.sources import api, html, pdf, resume, tabular

CFG = FusionConfig(as_of=2026)


def each(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_phone(spark):
    cases = {"+14155552671": "+14155552671", "(415) 555-2671": "+14155552671", "415-555-2671": "+14155552671", "+919876543210": "+919876543210", "not-a-number": None, "12345": None, "": None, None: None, "1 415 555 2671": "+14155552671", "+1 115 555 2671": None, "011 44 20 7946 0958": "+442079460958"}
    assert each(spark, S.normalize_phone, cases) == list(cases.values())
    assert each(spark, S.phone_valid, ["+14155552671", "415-555-2671", "not-a-phone", None]) == [True, False, False, False]


def test_date(spark):
    cases = {
        "2022-01": "2022-01", "2022": "2022-01", "Jan 2020": "2020-01", "Present": "present", "present": "present", "Current": "present", "–": "present", None: None, "": None, " now ": "present", "2020-13": "2020-13",
        "January 2020": "2020-01", "Sept 2020": "2020-09", "Sep. 2020": "2020-09", "2020/03": "2020-03", "03/2020": "2020-03", "3/2020": "2020-03", "12/31/2020": "2020-12", "31/12/2020": "2020-12", "2020-03-15": "2020-03",
        "Mar 15, 2020": "2020-03", "15 Mar 2020": "2020-03", "2020-3": "2020-03", "January, 2020": "2020-01", "Mar": "2000-03", "15": "2000-01", "May 18": "2000-05", "Q1 2020": None, "Summer 2019": None, "20201": None, "202003": None, "Jan 2022 · 2 yrs": None, "13/13/2020": None,
    }
    assert dict(zip(cases, each(spark, S.normalize_date, cases))) == cases
    once = each(spark, S.normalize_date, cases)
    assert each(spark, S.normalize_date, once) == once


def test_dates_against_a_general_parser(spark):
    """Forms beside the plain ones, as the general parser of the standard stack reads them."""
    parser = pytest.importorskip("dateutil.parser")
    from datetime import datetime

    cases = ["Mon, 15 Mar 2020", "Sunday March 15 2020", "15th March 2020", "March 1st, 2020", "3rd of May 2019", "2020-03-15T10:20:30", "2020-03-15 10:20", "2020-03-15T10:20:30Z", "Mar 15 2020 7:05 pm", "12/31/2020 23:59", "Mar 15 98", "15 Mar '21", "3/15/20", "15/3/20", "98/03/15", "1/2/99", "Tue 2021-06-01", "2nd Jan 2001", "4 July 1999 08:00:00"]
    expected = [parser.parse(x, default=datetime(2000, 1, 1)).strftime("%Y-%m") for x in cases]
    assert dict(zip(cases, each(spark, S.normalize_date, cases))) == dict(zip(cases, expected))


def test_skills(spark):
    assert each(spark, S.canonical_skill, ["ML", "Machine learning", "C Plus Plus", "c++", "C++ Programming", " Cooking "]) == ["Machine Learning", "Machine Learning", "C++", "C++", "C++", "Cooking"]
    assert each(spark, S.canonical_skills, [["ml", "x", "Machine Learning", "X"], [], None], "array<string>") == [["Machine Learning", "x", "X"], [], None]
    assert each(spark, S.normalize_country, ["USA", " india ", "Mars", None, ""]) == ["US", "IN", None, None, None]


def test_locations_and_ids(spark):
    got = each(spark, S.parse_location, ["San Francisco, CA", "a, b, c, d", "Paris, fr", "Oslo", " , ", " ", None, ","])
    assert [tuple(x) if x else None for x in got] == [("San Francisco", "CA", "US"), ("a", "b", "c"), ("Paris", "fr", None), ("Oslo", None, None), (",", None, None), None, None, (",", None, None)]
    row = spark.range(1).select(S.candidate_id(F.lit("n"), F.array(F.lit(fixtures.MAIL.title() + " ")), F.array().cast("array<string>")).alias("x"))
    assert row.first().x == "cand_163f6246af42"


def test_dedupe_and_validity(spark):
    assert each(spark, S.dedupe_ci, [["a ", "A", "", "b", " a"], []], "array<string>") == [["a", "b"], []]
    assert each(spark, S.email_valid, ["user@example.com", "userexample.com", "", None]) == [True, False, False, False]


def test_token_sort_ratio(spark):
    def longer(row, c, b):
        out = [0]
        for j, x in enumerate(b):
            out.append(row[j] + 1 if x == c else max(row[j + 1], out[-1]))
        return out

    def plain(a, b):
        a, b = (" ".join(sorted(x.lower().split())) for x in (a, b))
        row = [0] * (len(b) + 1)
        for c in a:
            row = longer(row, c, b)
        return 200 * row[-1] / (len(a) + len(b)) if a or b else 100.0

    r = random.Random(3)
    pairs = [("".join(r.choice("ab c") for _ in range(r.randrange(9))), "".join(r.choice("ab c") for _ in range(r.randrange(9)))) for _ in range(60)]
    pairs += [("Jon Smith", "smith john"), ("Nadia Okonkwo", "Okonkwo Nadia")]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for x in frame.select("a", "b", S.token_sort_ratio(F.col("a"), F.col("b")).alias("x")).collect():
        assert abs(x.x - plain(x.a, x.b)) < 1e-9, (x.a, x.b)


@pytest.mark.parametrize("a, b, same", [
    (("x@y.co", None), (" X@Y.co ", None), True),
    ((None, "(415) 555-2671"), (None, "+14155552671"), True),
    (("a@b.co", None), ("c@d.co", None), False),
    ((None, None), (None, None), False),
    (("", "bad"), ("", "bad"), False),
])
def test_same_candidate(spark, a, b, same):
    frame = spark.createDataFrame([(a, b)], "a struct<email:string,phone:string>, b struct<email:string,phone:string>")
    assert frame.select(matching.same_candidate(F.col("a"), F.col("b")).alias("x")).first().x is same
    left, right = (spark.createDataFrame([(1, *x)], "id int, email string, phone string") for x in (a, b))
    assert (matching.matches(left, right).count() == 1) is same


def profiles(spark, **sources):
    frames = {}
    for name, fields in sources.items():
        fields = fields if isinstance(fields, list) else [fields]
        rows = [{"candidate_key": "1", **f} for f in fields]
        columns = sorted({c for r in rows for c in r})
        frames[name] = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ", ".join(f"{c} {SOURCE_PROFILE[c]}" for c in columns))
    return merge.normalized(unified(frames), CFG)


def test_merge_rules(spark):
    job = ("Dev", "Acme", "2020-01", "present", None, "resume")
    longer = ("dev ", "ACME", "2020-01", "2021-01", "text", "linkedin")
    old = (None, "Old", None, None, "x", "linkedin")
    p = profiles(
        spark,
        csv={"name": "Al", "email": "A@B.co", "phone": "415-555-2671"},
        resume={"name": "Alan B", "email": "a@b.co", "phones": ["+14155552671", "bad"], "skills": ["ml", "Go"], "experience": [job], "education": [("S", "D", None, None, None, "resume")], "headline": ""},
        linkedin={"name": "Alan C", "headline": "H", "skills": ["Machine Learning", "golang"], "experience": [old, longer], "education": [("s", "d", "F", None, None, "linkedin"), ("T", None, None, None, None, "linkedin")], "profile_url": "l", "location_raw": "Rome, IT"},
        github={"email": "z@z.co", "profile_url": "g", "website": "w", "github_repos": ["r"], "bio": "b"},
    )
    m = merge.merge_profiles(p, CFG).first()
    assert m.full_name == "Alan B" and m.provenance["full_name"].source == "resume"
    assert m.emails == ["a@b.co", "z@z.co"] and m.email == "a@b.co" and m.confidence["email"] == 0.98
    assert m.phones == ["+14155552671"]
    assert m.skills == ["Machine Learning", "Go"] and m.confidence["skills"] == 0.8
    assert [(e.title, e.company, e.description) for e in m.experience] == [("dev ", "ACME", "text"), (None, "Old", "x")]
    assert [(e.school, e.field_of_study) for e in m.education] == [("s", "F"), ("T", None)]
    assert tuple(m.links) == ("l", "g", "w") and m.provenance["links"].source == "linkedin"
    assert m.headline == "H" and m.location.country == "US" and m.years_experience == 2.0
    assert m.github_repos == ["r"] and m.github_languages == [] and m.sources_used == ["csv", "resume", "linkedin", "github"]


def test_merge_is_independent_of_order(spark):
    r = random.Random(1)
    rows = [(str(k), s, r.choice(["A", "Bb", "Cc", None]), r.choice(["x@y.co", "X@y.co", None])) for k in range(30) for s in ("github", "csv", "linkedin", "other") if r.random() < 0.8]
    frames = [aligned(spark.createDataFrame(x, "candidate_key string, source string, name string, email string"), "", 0) for x in (rows, rows[::-1])]
    a, b = (sorted(map(str, merge.merge_profiles(f.repartition(n), CFG).collect())) for f, n in zip(frames, (1, 5)))
    assert a == b


def test_empty_merge(spark):
    m = merge.merge_profiles(profiles(spark, csv={"name": None}), CFG)
    row = m.withColumn("w", validation.profile_warnings(CFG)).first()
    assert row.overall_confidence == 0.0 and row.candidate_id is None
    assert row.w == ["No name found in any source", "No email found in any source", "No skills extracted from any source", "Overall confidence is low (0.00); verify source quality"]


def test_conflicts(spark):
    p = profiles(spark, csv={"name": "Ann Lee", "email": "a@b.co"}, resume={"name": "Bob Ray", "email": "c@d.co"}, linkedin={"name": "Lee Ann"})
    assert [(r.source, r.email_conflict, r.phone_conflict, r.name_conflict) for r in matching.conflicts(p, CFG).collect()] == [("resume", True, False, True)]


def out(spark, config, **sources):
    return json.loads(projection.project_json(fuse({k: p for k, p in sources.items()}, CFG, config), config, CFG).first().json)


def test_projection(spark):
    source = spark.createDataFrame([("1", "Ann", "a@b.co", ["ml", "x"])], "candidate_key string, name string, email string, skills array<string>")
    full = out(spark, {}, csv=source)
    assert list(full)[:4] == ["candidate_id", "full_name", "emails", "phones"] and full["phones"] is None
    assert full["warnings"] == ["Output schema validation failed: ('phones',): Input should be a valid list"]
    assert "name" not in full["provenance"] and full["confidence"]["emails"] == 0.98
    some = out(spark, {"include": ["name", "email", "phones", "headline"], "rename": {"full_name": "who", "email": "mail"}, "missing_policy": "omit", "show_provenance": False}, csv=source)
    assert some == {"who": "Ann", "mail": ["a@b.co"], "confidence": {"who": 0.95, "mail": 0.98}, "sources_used": ["csv"]}
    renamed = out(spark, {"rename": {"emails": "e"}, "show_confidence": False}, csv=source)
    assert "Output schema validation failed: ('emails',): Field required" in renamed["warnings"]
    assert out(spark, {"include": ["skills"], "normalize": False, "show_confidence": False, "show_provenance": False}, csv=source)["skills"] == ["Machine Learning", "x"]
    with pytest.raises(projection.ProjectionError):
        out(spark, {"missing_policy": "maybe"}, csv=source)
    with pytest.raises(Exception, match="Required field 'phones'"):
        out(spark, {"include": ["phones"], "missing_policy": "error"}, csv=source)


def test_config_files(tmp_path):
    assert projection.load_config(None) == {}
    with pytest.raises(FileNotFoundError):
        projection.load_config(str(tmp_path / "no.json"))
    (tmp_path / "l.json").write_text("[]")
    with pytest.raises(projection.ProjectionError):
        projection.load_config(str(tmp_path / "l.json"))


def plain_experience(lines):
    """A fold over lines with one line of lookahead, as a check of the closed form."""
    import re

    when = re.compile(resume.RANGE, re.I)
    lines = [x.strip() for x in lines if x.strip()]
    out, title, text = [], None, []
    for i, line in enumerate(lines):
        m = when.search(line)
        if m:
            before = line[: m.start()].strip().rstrip(",|–- ") or None
            halves = re.split(r"\s+at\s+", before, maxsplit=1, flags=re.I) if before and " at " in before.lower() else None
            text = []
            out.append([(halves[0].strip() or title) if halves else title, (halves[1].strip() or None) if halves else before, text])
            title = None
        elif i + 1 < len(lines) and when.search(lines[i + 1]) or not out:
            title = line
        else:
            text.append(line)
    return [(t, c, " ".join(x) or None) for t, c, x in out]


def test_experience_against_a_fold(spark):
    r = random.Random(5)
    pool = ["Dev", "Lead at Acme, 2019 - 2020", "Acme | Jan 2020 – Present", "2001 - 2002", "did it", " ", "", "Boss at  X 1999-2000 x", "more"]
    cases = [[r.choice(pool) for _ in range(r.randrange(12))] for _ in range(150)]
    got = each(spark, resume.experience_entries, cases, "array<string>")
    for lines, entries in zip(cases, got):
        assert [(e.title, e.company, e.description) for e in entries] == plain_experience(lines), lines


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Name ,EMAIL,phone\nAnn, a@b.co ,\nNA,,\n")
    rows = tabular.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [(x.name, x.email, x.phone, x.current_title) for x in rows] == [("Ann", "a@b.co", None, None), ("NA", None, None, None)]
    (tmp_path / "h.csv").write_text("name,email\n")
    assert tabular.read_csv(spark, str(tmp_path / "h.csv")).collect() == []
    assert tabular.missing_columns(["Name ", "email"]) == ["current_company", "phone", "title"]


def test_rows_without_contact_are_candidates_of_their_own(spark):
    rows = spark.createDataFrame([("Al", None, "x"), ("al", None, "y"), ("Al", " A@b.co", "x")], "name string, email string, title string")
    keys = [x.candidate_key for x in tabular.table_profiles(rows).collect()]
    assert len(set(keys)) == 3 and "a@b.co" in keys


def test_users(spark):
    frame = spark.createDataFrame([(fixtures.JSON,), (json.dumps(fixtures.USER["user"] | {"name": "", "blog": ""}),)], "value string")
    a, b = api.user_profiles(api.parsed(frame, "value")).collect()
    assert a.github_repos == ["mooring", "charts", "tidewater", "notes"] and a.github_languages == ["Python", "Scala", "R"]
    assert (b.name, b.website, b.github_repos) == ("nokonkwo", "https://github.com/nokonkwo", [])
    assert [api.username(x) for x in ("https://github.com/ab/c", " @cd ", "github.com/x?y")] == ["ab", "cd", "x"]


def test_rest_without_network_gives_an_empty_profile(spark):
    row = api.read_rest(spark, ["@nobody"], api="http://127.0.0.1:9").first()
    assert row.candidate_key == "nobody" and row.name is None and row.github_repos == []


def test_html():
    p = html.page(fixtures.HTML)
    assert (p["name"], p["headline"], p["location_raw"]) == ("Nadia Okonkwo", "Data Platform Lead | Streams", "Oakland & nearby")
    assert [(e["a"], e["b"], e["start"], e["end"]) for e in p["jobs"]] == [("Data Platform Lead", "Harbor Labs", "Mar 2021", "Present"), ("Pipeline Engineer", "Quayside", "Feb 2018", "Feb 2021")]
    assert [e["a"] for e in p["schools"]] == ["Lagos Institute"] and [x for x in p["skills"] if len(x) < 12] == ["Python", "k8s", "Spark SQL"]
    assert html.page("<section><h2>Education</h2><li>ETH <b>x</b></li></section><a href='https://linkedin.com/in/q'>") | {"skills": 0} == {"name": None, "headline": None, "location_raw": None, "profile_url": "https://linkedin.com/in/q", "jobs": [], "schools": [{"a": "ETH x", "b": None, "start": None, "end": None}], "skills": 0}
    assert html.page(None)["name"] is None and html.page("<div>" * 5000)["jobs"] == []


def test_end_to_end(spark, tmp_path):
    paths = {}
    for name, data in (("a.csv", fixtures.CSV.encode()), ("u.json", fixtures.JSON.encode()), ("p.html", fixtures.HTML.encode()), ("r.txt", fixtures.RESUME.encode()), ("r.pdf", pdf.pdf_of(fixtures.RESUME))):
        (tmp_path / name).write_bytes(data)
        paths[name] = str(tmp_path / name)
    same = [run(spark, paths["a.csv"], paths[r], paths["p.html"], paths["u.json"], cfg=CFG).first().json for r in ("r.txt", "r.pdf")]
    assert same[0] == same[1]
    got = json.loads(run(spark, paths["a.csv"], paths["r.txt"], paths["p.html"], paths["u.json"], cfg=CFG).first().json)
    assert got["candidate_id"] == "cand_163f6246af42" and got["overall_confidence"] == 0.8981 and got["years_experience"] == 9.0
    assert got["emails"] == [fixtures.MAIL] and got["phones"] == ["+16285550134"] and "warnings" not in got
    assert [(e["title"], e["company"]) for e in got["experience"]] == [("Data Platform Lead", "Harbor Labs"), ("Pipeline Engineer", "Quayside")]
    assert got["experience"][0]["description"] == "Moved nightly jobs to streams."  # the line right above the next dates would be its title
    target = tmp_path / "out.json"
    assert main(["transform", "--csv", paths["a.csv"], "--resume", paths["r.pdf"], "-o", str(target)]) == 0
    assert json.loads(target.read_text())["emails"] == [fixtures.MAIL]
    only = json.loads(run(spark, csv=paths["a.csv"], cfg=CFG).first().json)
    assert only["full_name"] == "Nadia Okonkwo" and only["sources_used"] == ["csv"]
    with pytest.raises(ValueError):
        run(spark)
    with pytest.raises(ValueError):
        run(spark, csv=str(tmp_path / "none.csv"))


@pytest.mark.parametrize("compact", [1, 20])
def test_stream(spark, tmp_path, compact):
    from braid.streaming.updates import fuse_stream

    inbox = tmp_path / "in"
    rows = [[("1", "csv", "Al"), ("2", "csv", "Bo"), (None, "csv", "No")], [("1", "resume", "Alan")], [("2", "csv", "Bob"), ("1", "csv", "Al B. Alan")]]
    for i, batch in enumerate(rows):
        frame = aligned(spark.createDataFrame(batch, "candidate_key string, source string, name string"), "", 0)
        frame.coalesce(1).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(frame.schema).parquet(str(inbox))
        fuse_stream(stream, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "check"), CFG, once=True, buckets=4, compact=compact).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.batch, r.candidate_key): r.full_name for r in found} == {(0, "1"): "Al", (0, "2"): "Bo", (1, "1"): "Alan", (2, "1"): "Al B. Alan", (2, "2"): "Bob"}
    assert {tuple(r.sources_used) for r in found if r.batch == 2} == {("csv", "resume"), ("csv",)}
    assert all("No email found in any source" in r.warnings for r in found)
