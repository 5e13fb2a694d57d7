"""Output chosen by a configuration: fields, names, normalization, confidence and provenance blocks, and what missing values do."""
from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braid.config import FusionConfig
from braid.functions.scalars import canonical_skills, let, normalize_phone
from braid.operators.validation import output_warnings

# Fields of the default output, and older names of some.
FIELDS = ("candidate_id", "full_name", "emails", "phones", "location", "links", "headline", "years_experience", "skills", "experience", "education", "provenance", "overall_confidence")
OLDER = {"name": "full_name", "email": "emails", "phone": "phones", "profile_url": "links", "website": "links"}
SHORT = {"full_name": "name", "emails": "email", "phones": "phone"}


class ProjectionError(Exception):
    pass


def load_config(path: str | None) -> dict:
    if not path:
        return {}
    if not os.path.exists(path):
        raise FileNotFoundError(f"no projection config at {path}")
    with open(path) as f:
        config = json.load(f)
    if not isinstance(config, dict):
        raise ProjectionError("a projection config is a JSON object")
    return config


def wants(normalize, name: str) -> bool:
    if isinstance(normalize, dict):
        return bool(normalize.get(name, normalize.get("all", False)))
    if isinstance(normalize, (list, tuple)):
        return name in normalize or "all" in normalize
    return normalize is True


class Projection:
    """A configuration, compiled against the columns of canonical profiles."""

    def __init__(self, config: dict, columns: list[str], cfg: FusionConfig | None = None):
        self.config, self.columns, self.cfg = config, columns, cfg or FusionConfig()
        self.missing = config.get("missing_policy", "null")
        if self.missing not in ("null", "omit", "error"):
            raise ProjectionError("missing_policy must be one of: null, omit, error")
        self.rename = config.get("rename") or {}
        self.show_confidence, self.show_provenance = config.get("show_confidence", True), config.get("show_provenance", True)
        self.fields = list(config.get("include") or FIELDS)

    def key(self, asked: str) -> str:
        name = OLDER.get(asked, asked)
        return self.rename.get(asked) or self.rename.get(name) or self.rename.get(SHORT.get(name, "")) or asked

    def value(self, asked: str) -> Column:
        name = OLDER.get(asked, asked)
        if name == "provenance":
            return F.map_filter("provenance", lambda k, _: k.isin([f for f in FIELDS if f != "provenance"]))
        if name not in self.columns:
            return F.lit(None).cast("string")
        value = F.col(name)
        if wants(self.config.get("normalize", True), name):
            if name == "phones":
                value = F.filter(F.transform(value, lambda p: normalize_phone(p, self.cfg)), lambda p: p.isNotNull())
            if name == "skills":
                value = canonical_skills(value, self.cfg)
        return value

    def empty(self, asked: str, value: Column) -> Column:
        """Empty lists are missing only where they are asked for by these names."""
        if asked in ("emails", "phones"):
            return value.isNull() | (F.size(value) == 0)
        if OLDER.get(asked, asked) == "provenance":
            return value.isNull() | (F.size(F.map_keys(value)) == 0)
        return value.isNull()

    def values(self) -> dict[str, tuple[str, Column, Column]]:
        """Of each output key: what was asked for, whether it is missing, and its value. The last of equal keys counts."""
        out = {}
        for asked in self.fields:
            if OLDER.get(asked, asked) == "provenance" and not self.show_provenance:
                continue
            value = self.value(asked)
            missing = self.empty(asked, value)
            failure = F.raise_error(F.lit(f"Required field '{asked}' is missing from profile")) if self.missing == "error" else F.lit(None)
            out[self.key(asked)] = (asked, missing, F.when(missing, failure).otherwise(value))
        return out

    def block(self, of: str, keep) -> Column:
        """A map of output keys to what the profile's map `of` holds of their fields; null if it would be empty."""
        def pairs(all_: Column) -> Column:
            by_key: dict[str, list[Column]] = {}
            for asked in self.fields:
                name = OLDER.get(asked, asked)
                found = [keep(F.try_element_at(all_, F.lit(k))) for k in dict.fromkeys((name, asked, SHORT.get(name, name)))]
                by_key.setdefault(self.key(asked), []).insert(0, F.coalesce(*found))
            return F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(*v).alias("v")) for k, v in by_key.items()]), lambda x: x["v"].isNotNull())

        return let(let(F.col(of), pairs), lambda found: F.when(F.size(found) > 0, F.map_from_entries(found)))

    def outputs(self) -> dict[str, tuple[Column, Column]]:
        """Of each output key, in order: whether it is there (None: if it isn't null), and its value."""
        out = {k: (~missing if self.missing == "omit" else F.lit(True), value) for k, (_, missing, value) in self.values().items()}
        if self.show_confidence:
            block = self.block("confidence", lambda c: F.nullif(c, F.lit(0.0)))
            out["confidence"] = (None, block)
        if self.show_provenance and "provenance" not in out:
            block = self.block("provenance", lambda p: p)
            out["provenance"] = (None, block)
        out["sources_used"] = (F.lit(True), F.col("sources_used"))
        return out

    def warnings(self) -> Column:
        if self.config.get("include"):
            return F.array().cast("array<string>")
        return output_warnings(self.outputs())


def project(profiles: DataFrame, config: dict | None = None, cfg: FusionConfig | None = None) -> DataFrame:
    """A column per output key, null where a profile lacks it, after candidate_key. Columns that aren't asked for are pruned."""
    p = Projection(config or {}, profiles.columns, cfg)
    return profiles.select("candidate_key", *[value.alias(k) for k, (_, value) in p.outputs().items()])


def project_json(profiles: DataFrame, config: dict | None = None, cfg: FusionConfig | None = None) -> DataFrame:
    """(candidate_key, json). Only text can leave out keys row by row: under "omit" missing fields aren't there; else they are null.
    Null fields inside values are left out. Warnings come last, if there are any and the profiles have that column."""
    p = Projection(config or {}, profiles.columns, cfg)

    def member(key: str, there: Column | None, value: Column) -> Column:
        def text(inner: Column) -> Column:
            null = F.lit(None) if there is None else F.lit(json.dumps(key) + ":null")
            return F.when(inner == "{}", null).otherwise(F.substring(inner, F.lit(2), F.length(inner) - 2))

        out = let(F.to_json(F.struct(value.alias(key))), text)
        return out if there is None else F.when(there, out)

    members = [member(k, there, value) for k, (there, value) in p.outputs().items()]
    if "warnings" in profiles.columns:
        members.append(member("warnings", F.size("warnings") > 0, F.col("warnings")))
    return profiles.select("candidate_key", F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*members)), ","), F.lit("}")).alias("json"))
