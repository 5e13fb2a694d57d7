"""CSV exports: a row is a candidate."""
from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braid.functions.scalars import trimmed, truthy

log = logging.getLogger(__name__)
#: Columns of the export, and the profile's fields.
EXPECTED = {"name": "name", "email": "email", "phone": "phone", "current_company": "current_company", "title": "current_title"}


def missing_columns(columns: list[str]) -> list[str]:
    return sorted(set(EXPECTED) - {c.strip().lower() for c in columns})


def cell(df: DataFrame, name: str) -> Column:
    """Trimmed text of a column whose name matches but for case and spaces; null if blank or not there."""
    found = next((c for c in df.columns if c.strip().lower() == name), None)
    return F.lit(None).cast("string") if found is None else truthy(trimmed(df[f"`{found}`"].cast("string")))


def table_profiles(df: DataFrame, key: Column | None = None) -> DataFrame:
    """Source profiles of any table with some of the expected columns. Without a key, the row's e-mail or phone is one, else the row
    itself: people of one name aren't one candidate."""
    if missing := missing_columns(df.columns):
        log.warning("columns not there: %s", missing)
    fields = {to: cell(df, c) for c, to in EXPECTED.items()}
    row = F.concat(F.lit("row-"), F.hex(F.xxhash64(*fields.values())))
    own = F.lower(F.coalesce(fields["email"], fields["phone"], row))
    return df.select((own if key is None else key.cast("string")).alias("candidate_key"), *[c.alias(n) for n, c in fields.items()])


def read_csv(spark: SparkSession, path: str, key: str | None = None, first_row_only: bool = False) -> DataFrame:
    """All values are text, "NA" included. first_row_only takes one candidate from the file."""
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").option("nullValue", "").option("multiLine", True).option("escape", '"').csv(path)
    return table_profiles(df.limit(1) if first_row_only else df, None if key is None else F.col(key))
