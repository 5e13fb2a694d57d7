"""Checks that say what is wrong instead of failing."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from braid.config import FusionConfig
from braid.functions.scalars import email_valid, phone_valid


def quoted(x: Column) -> Column:
    """The text in quotes, as a Python literal shows it (without rarer escapes)."""
    escaped = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    double = x.contains("'") & ~x.contains('"')
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def profile_warnings(cfg: FusionConfig | None = None) -> Column:
    """Warnings of a canonical profile, in order; for use in a select over merge_profiles()."""
    cfg = cfg or FusionConfig()
    bad_mail = F.transform(F.filter("emails", lambda x: ~email_valid(x)), lambda x: F.concat(F.lit("Invalid email format: "), quoted(x)))
    bad_phone = F.transform(F.filter("phones", lambda x: ~phone_valid(x, cfg)), lambda x: F.concat(F.lit("Phone is not valid E.164: "), quoted(x)))
    low = F.col("overall_confidence") < cfg.low_confidence
    single = F.array_compact(
        F.array(
            F.when(F.col("full_name").isNull(), "No name found in any source"),
            F.when(F.size("emails") == 0, "No email found in any source"),
            F.when(F.size("skills") == 0, "No skills extracted from any source"),
            F.when(low, F.concat(F.lit("Overall confidence is low ("), F.format_string("%.2f", F.col("overall_confidence")), F.lit("); verify source quality"))),
        )
    )
    return F.concat(bad_mail, bad_phone, single)


# Required keys of a complete output, what they must be, and what is said of an empty one.
REQUIRED = {"candidate_id": ("string", None), "full_name": ("string", None), "emails": ("list", "Value error, emails must contain at least one address"), "phones": ("list", "Value error, phones must contain at least one number"), "overall_confidence": ("number", None)}


def output_warnings(values: dict[str, tuple[Column, Column]]) -> Column:
    """Warnings of an output without an explicit choice of fields. values: for each output key whether it is there, and its value."""
    out = []
    for key, (kind, empty) in REQUIRED.items():

        def said(text, key=key):
            return F.lit(f"Output schema validation failed: ('{key}',): {text}")

        if key not in values:
            out.append(said("Field required"))
            continue
        there, value = values[key]
        rule = F.when(~there, said("Field required")).when(value.isNull(), said(f"Input should be a valid {kind}"))
        out.append(rule.when(F.size(value) == 0, said(empty)) if empty else rule)
    return F.array_compact(F.array(*out))
