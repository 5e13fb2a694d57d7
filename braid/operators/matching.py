"""Which records are of one candidate: equal e-mail or equal phone."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braid.config import FusionConfig
from braid.functions.scalars import names_match, normalize_phone, phones_match, priority, trimmed, truthy


def email_key(x):
    return truthy(trimmed(F.lower(x)))


def matches(left: DataFrame, right: DataFrame, cfg: FusionConfig | None = None, by: tuple[str, ...] = ("email", "phone")) -> DataFrame:
    """Distinct (id_a, id_b) of rows (id, email, phone) that match. One equi-join per key instead of a join on either: no loop over
    pairs, and adaptive execution can split keys that many rows share. The pairs of a key are as many as both sides' rows multiply
    to; for classes of records instead of pairs, whatever the sizes, use entities.entity_keys()."""
    cfg = cfg or FusionConfig()
    keys = {"email": email_key, "phone": lambda x: normalize_phone(x, cfg)}
    out = None
    for name in by:
        a = left.select(F.col("id").alias("id_a"), keys[name](F.col(name)).alias("k")).filter("k is not null")
        b = right.select(F.col("id").alias("id_b"), keys[name](F.col(name)).alias("k")).filter("k is not null")
        found = a.join(b, "k").select("id_a", "id_b")
        out = found if out is None else out.union(found)
    return out.distinct()


def same_candidate(a, b, cfg: FusionConfig | None = None):
    """The same of two structs (email, phone), as a condition."""
    cfg = cfg or FusionConfig()
    return F.coalesce(email_key(a["email"]) == email_key(b["email"]), F.lit(False)) | phones_match(a["phone"], b["phone"], cfg)


def conflicts(profiles: DataFrame, cfg: FusionConfig | None = None) -> DataFrame:
    """(candidate_key, source, anchor_source, email_conflict, phone_conflict, name_conflict): records that may describe someone else
    than the first record under their key. Missing values are no conflict; fusion goes on regardless."""
    cfg = cfg or FusionConfig()
    record = F.struct("source", "email", "phone", F.coalesce(truthy(F.col("name")), truthy(F.col("full_name"))).alias("name"))
    order = Window.partitionBy("candidate_key").orderBy(priority(F.col("source"), cfg), "seq")
    rows = profiles.select("candidate_key", record.alias("r"), F.first(record).over(order).alias("a"), F.row_number().over(order).alias("n"))
    a, r = F.col("a"), F.col("r")

    def both(field):
        return truthy(a[field]).isNotNull() & truthy(r[field]).isNotNull()

    return (
        rows.filter((F.col("n") > 1) & ~same_candidate(a, r, cfg))
        .select(
            "candidate_key",
            r["source"].alias("source"),
            a["source"].alias("anchor_source"),
            (both("email") & (trimmed(F.lower(a["email"])) != trimmed(F.lower(r["email"])))).alias("email_conflict"),
            (both("phone") & ~phones_match(a["phone"], r["phone"], cfg)).alias("phone_conflict"),
            (both("name") & ~names_match(a["name"], r["name"], cfg)).alias("name_conflict"),
        )
        .filter("email_conflict or phone_conflict or name_conflict")
    )
