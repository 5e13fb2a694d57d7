"""Fusion: one shuffle brings a candidate's source profiles together; all rules are array expressions over them, in priority order."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braid.config import FusionConfig
from braid.functions.scalars import candidate_id, canonical_skills, confidence, dedupe_ci, let, normalize_date, normalize_phone, overall_confidence, parse_location, priority, rounded, trimmed, truthy, years_experience
from braid.schema import EDUCATION, EXPERIENCE, SOURCE_PROFILE

#: Order of the fields in the confidence and provenance maps.
FIELDS = ("full_name", "name", "emails", "email", "phones", "phone", "candidate_id", "location", "headline", "current_company", "current_title", "bio", "links", "skills", "experience", "years_experience", "education", "github_repos", "github_languages")


def normalized(profiles: DataFrame, cfg: FusionConfig | None = None) -> DataFrame:
    """Phones to E.164 (others are dropped), dates of entries to YYYY-MM. No shuffle."""
    cfg = cfg or FusionConfig()

    def dated(e: Column) -> Column:
        return e.withField("start_date", normalize_date(e["start_date"])).withField("end_date", normalize_date(e["end_date"]))

    return profiles.withColumns(
        {
            "phone": normalize_phone(F.col("phone"), cfg),
            "phones": F.filter(F.transform("phones", lambda p: normalize_phone(p, cfg)), lambda p: p.isNotNull()),
            "experience": F.transform("experience", dated),
            "education": F.transform("education", dated),
        }
    )


def best_by_key(all_entries: Column, key, rank) -> Column:
    """array<struct<e, i>>: of entries with equal keys the one of the least rank, the first of equals, i being where its key is
    first met; by key. Two sorts bring equal keys together, so the work grows like n log n."""

    def heads(ordered: Column) -> Column:
        return let(ordered, lambda xs: F.filter(xs, lambda x, j: (j == 0) | (x["k"] != F.get(xs, j - 1)["k"])))

    def found(xs: Column) -> Column:
        best = heads(F.sort_array(xs))
        met = heads(F.sort_array(F.transform(xs, lambda x: F.struct(x["k"].alias("k"), x["i"].alias("i")))))
        return F.transform(F.arrays_zip(best.alias("best"), met.alias("met")), lambda z: F.struct(z["best"]["e"].alias("e"), z["met"]["i"].alias("i")))

    return let(F.transform(all_entries, lambda e, i: F.struct(key(e).alias("k"), rank(e).alias("r"), i.alias("i"), e.alias("e"))), found)


def _key(x: Column) -> Column:
    return trimmed(F.lower(F.coalesce(x, F.lit(""))))


def merged_experience(all_entries: Column) -> Column:
    """One entry per company, title and start: the longest description, the first of equals. Latest start first, none last."""
    found = best_by_key(
        all_entries,
        lambda e: F.struct(_key(e["company"]).alias("c"), _key(e["title"]).alias("t"), F.coalesce(e["start_date"], F.lit("")).alias("s")),
        lambda e: -F.length(F.coalesce(e["description"], F.lit(""))),
    )

    def later(x, y):
        a, b = (F.coalesce(v["e"]["start_date"], F.lit("")) for v in (x, y))
        return F.when(a > b, -1).when(a < b, 1).otherwise(x["i"] - y["i"])

    return F.transform(F.array_sort(found, later), lambda x: x["e"])


def merged_education(all_entries: Column) -> Column:
    """One entry per school and degree, in the order of their first ones: the first with a field of study, else the first."""
    found = best_by_key(
        all_entries,
        lambda e: F.struct(_key(e["school"]).alias("s"), _key(e["degree"]).alias("d")),
        lambda e: F.when(F.coalesce(e["field_of_study"], F.lit("")) != "", 0).otherwise(1),
    )
    return F.transform(F.sort_array(F.transform(found, lambda x: F.struct(x["i"].alias("i"), x["e"].alias("e")))), lambda x: x["e"])


def _some(array: Column) -> Column:
    return F.coalesce(F.size(array) > 0, F.lit(False))


def _flat(ps: Column, values) -> Column:
    return F.flatten(F.transform(ps, lambda p: F.coalesce(values(p), F.array().cast("array<string>"))))


def _one(x: Column) -> Column:
    return F.when(truthy(x).isNotNull(), F.array(x)).otherwise(F.array().cast("array<string>"))


def _either(list_: Column, single: Column) -> Column:
    return F.concat(F.coalesce(list_, F.array().cast("array<string>")), _one(single))


def _lead() -> Column:
    """A record's first e-mail."""
    return F.when(_some(F.col("emails")), truthy(F.get("emails", F.lit(0)))).otherwise(truthy(F.col("email")))


def collected(profiles: DataFrame, cfg: FusionConfig) -> DataFrame:
    """(candidate_key, ps): a candidate's profiles by priority, then seq. A key's profiles are a handful, one per source; records
    without a key can't be fused and are dropped."""
    fields = [c for c in SOURCE_PROFILE if c != "candidate_key"]
    row = F.struct(priority(F.col("source"), cfg).alias("prio"), F.col("seq"), *[F.col(c) for c in fields if c != "seq"])
    order = F.struct(priority(F.col("source"), cfg).alias("prio"), F.col("seq"), F.xxhash64(row).alias("h"))
    # what the rules read more than once is made here, once for each record and before the shuffle
    ready = F.struct(row["prio"].alias("prio"), "seq", *[c for c in fields if c != "seq"], _either(F.col("phones"), F.col("phone")).alias("all_phones"), parse_location(F.col("location_raw"), cfg.places_trim_spaces_only).alias("place"), trimmed(F.lower(_lead())).alias("lead"))
    grouped = profiles.filter("candidate_key is not null").groupBy("candidate_key").agg(F.collect_list(F.struct(order.alias("o"), ready.alias("p"))).alias("x"))
    return grouped.select("candidate_key", F.transform(F.array_sort("x", lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)), lambda x: x["p"]).alias("ps"))


def merge_profiles(profiles: DataFrame, cfg: FusionConfig | None = None) -> DataFrame:
    """One canonical profile per candidate_key, with confidence and provenance of each field that it has.

    profiles are normalized, of the columns of SOURCE_PROFILE. Empty text, empty lists and null all count as missing.
    """
    cfg = cfg or FusionConfig()
    ps = F.col("ps")

    def first(holds) -> Column:
        return F.get(F.filter(ps, holds), F.lit(0))

    def first_with(field: str) -> Column:
        return first(lambda p: truthy(p[field]).isNotNull())

    def full(p):
        return F.coalesce(truthy(p["full_name"]), truthy(p["name"]))

    def phones(p):
        return p["all_phones"]

    names = F.filter(F.transform(ps, lambda p, i: F.struct(F.length(full(p)).alias("n"), (-i).alias("i"), full(p).alias("v"), p["source"].alias("source"))), lambda x: x["v"].isNotNull())
    leads = F.filter(F.transform(ps, lambda p, i: F.struct((-confidence(p["source"], "emails", cfg)).alias("c"), p["prio"], i.alias("i"), p["lead"].alias("v"), p["source"].alias("source"))), lambda x: x["v"].isNotNull())
    base = collected(profiles, cfg).select("candidate_key", "ps", F.array_max(names).alias("n"), F.array_min(leads).alias("e"), *[first_with(f).alias(f"p_{f}") for f in ("headline", "current_company", "current_title", "bio", "website")])
    base = base.withColumns(
        {
            "emails": F.when(F.col("e.v") != "", dedupe_ci(F.concat(F.array("e.v"), _flat(ps, lambda p: _either(p["emails"], p["email"]))))),
            "phones": dedupe_ci(_flat(ps, phones)),
            "p_phone": first(lambda p: F.size(phones(p)) > 0),
            "p_location": first(lambda p: p["place"].isNotNull()),
            "p_linkedin": first(lambda p: (p["source"] == "linkedin") & truthy(p["profile_url"]).isNotNull()),
            "p_github": first(lambda p: (p["source"] == "github") & truthy(p["profile_url"]).isNotNull()),
            "p_links": first(lambda p: (p["source"].isin("linkedin", "github") & truthy(p["profile_url"]).isNotNull()) | truthy(p["website"]).isNotNull()),
            "skilled": F.filter(ps, lambda p: _some(p["skills"])),
            "worked": F.filter(ps, lambda p: _some(p["experience"])),
            "taught": F.filter(ps, lambda p: _some(p["education"])),
            "p_repos": F.try_element_at(F.filter(ps, lambda p: (p["source"] == "github") & _some(p["github_repos"])), F.lit(-1)),
            "p_languages": F.try_element_at(F.filter(ps, lambda p: (p["source"] == "github") & _some(p["github_languages"])), F.lit(-1)),
        }
    )
    base = base.withColumns(
        {
            "experience": merged_experience(F.coalesce(F.flatten(F.transform("worked", lambda p: p["experience"])), F.array().cast(EXPERIENCE))),
            "education": merged_education(F.coalesce(F.flatten(F.transform("taught", lambda p: p["education"])), F.array().cast(EDUCATION))),
            "skills": canonical_skills(F.flatten(F.transform("skilled", lambda p: p["skills"])), cfg),
            "full_name": F.col("n.v"),
            "candidate_id": candidate_id(F.col("n.v"), F.col("emails"), F.col("phones")),
        }
    )
    base = base.withColumn("years_experience", years_experience(F.col("experience"), cfg.as_of))

    has_phone, has_mail, none = F.size("phones") > 0, F.col("emails").isNotNull(), F.lit(None)

    def src(array):
        return F.get(F.col(array), F.lit(0))["source"]

    name, mail, phone = F.col("n.source"), F.when(has_mail, F.col("e.source")), F.when(has_phone, F.col("p_phone.source"))
    links = F.col("p_links.source")
    of = {  # field: source if the field is there, method, field that its confidence is looked up by
        "full_name": (name, "longest_name", "full_name"),
        "name": (name, "legacy_alias:full_name", "full_name"),
        "emails": (mail, "highest_confidence_deduped", "emails"),
        "email": (mail, "legacy_alias:emails", "emails"),
        "phones": (phone, "e164_normalized_deduped", "phones"),
        "phone": (phone, "legacy_alias:phones", "phones"),
        "candidate_id": (F.when(F.col("candidate_id").isNotNull(), F.coalesce(mail, phone, name, src("ps"))), "sha256_identity_key", None),
        "location": (F.col("p_location.source"), "structured_location_parse", None),
        **{f: (F.col(f"p_{f}.source"), "first_available", None) for f in ("headline", "current_company", "current_title", "bio")},
        "links": (links, "source_specific_link_map", None),
        "skills": (src("skilled"), "union_canonicalized", None),
        "experience": (src("worked"), "dedup_richest", None),
        "years_experience": (F.when(F.col("years_experience").isNotNull(), src("worked")), "derived_from_experience_dates", None),
        "education": (src("taught"), "dedup_detail", None),
        "github_repos": (F.col("p_repos.source"), "api", None),
        "github_languages": (F.col("p_languages.source"), "api", None),
    }
    mean = rounded(F.aggregate("skilled", F.lit(0.0), lambda acc, p: acc + confidence(p["source"], "skills", cfg)) / F.size("skilled"))
    there = F.filter(
        F.array(*[F.struct(F.lit(f).alias("field"), s.alias("source"), F.lit(m).alias("method"), (F.when(F.size("skilled") > 0, mean) if f == "skills" else confidence(s, by or f, cfg)).alias("c")) for f, (s, m, by) in of.items()]),
        lambda x: x["source"].isNotNull(),
    )
    empty = F.array().cast("array<string>")
    done = base.withColumn("__there", there).select(
        "candidate_key",
        "candidate_id",
        "full_name",
        F.coalesce("emails", empty).alias("emails"),
        "phones",
        F.col("p_location.place").alias("location"),
        F.struct(F.col("p_linkedin.profile_url").alias("linkedin"), F.col("p_github.profile_url").alias("github"), F.col("p_website.website").alias("website")).alias("links"),
        F.col("p_headline.headline").alias("headline"),
        "years_experience",
        F.coalesce("skills", empty).alias("skills"),
        "experience",
        "education",
        F.col("full_name").alias("name"),
        F.get(F.coalesce("emails", empty), F.lit(0)).alias("email"),
        F.get("phones", F.lit(0)).alias("phone"),
        F.col("p_current_company.current_company").alias("current_company"),
        F.col("p_current_title.current_title").alias("current_title"),
        F.col("p_bio.bio").alias("bio"),
        F.coalesce("p_repos.github_repos", empty).alias("github_repos"),
        F.coalesce("p_languages.github_languages", empty).alias("github_languages"),
        F.col("p_website.website").alias("website"),
        F.coalesce("p_linkedin.profile_url", "p_github.profile_url").alias("profile_url"),
        F.transform("ps", lambda p: p["source"]).alias("sources_used"),
        F.map_from_entries(F.transform("__there", lambda x: F.struct(x["field"], x["c"]))).alias("confidence"),
        F.map_from_entries(F.transform("__there", lambda x: F.struct(x["field"], F.struct(x["field"].alias("field"), x["source"].alias("source"), x["method"].alias("method"))))).alias("provenance"),
    )
    return done.withColumn("overall_confidence", overall_confidence(F.col("confidence"), cfg))
