"""From sources to output: narrow extraction and normalization, one shuffle by candidate, narrow rules, checks and projection."""
from __future__ import annotations

import logging
import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braid.config import FusionConfig
from braid.operators.entities import with_entity_keys
from braid.operators.matching import conflicts
from braid.operators.merge import merge_profiles, normalized
from braid.operators.projection import Projection, load_config, project_json
from braid.operators.validation import profile_warnings
from braid.schema import aligned

log = logging.getLogger(__name__)


def unified(sources: dict[str, DataFrame]) -> DataFrame:
    """The sources' profiles as one normalized table."""
    if not sources:
        raise ValueError("there is no source")
    return reduce(DataFrame.unionByName, [aligned(df, name) for name, df in sources.items()])


def fuse(sources: dict[str, DataFrame], cfg: FusionConfig | None = None, config: dict | None = None) -> DataFrame:
    """Canonical profiles with warnings. sources: profiles by source name, each with a candidate_key column."""
    cfg = cfg or FusionConfig()
    merged = merge_profiles(normalized(unified(sources), cfg), cfg)
    checked = merged.withColumn("warnings", profile_warnings(cfg))
    return checked.withColumn("warnings", F.concat("warnings", Projection(config or {}, merged.columns, cfg).warnings()))


def fuse_to_json(sources: dict[str, DataFrame], cfg: FusionConfig | None = None, config: dict | None = None) -> DataFrame:
    return project_json(fuse(sources, cfg, config), config, cfg)


def fuse_records(sources: dict[str, DataFrame], cfg: FusionConfig | None = None, config: dict | None = None) -> DataFrame:
    """Canonical profiles of whole tables of records that don't say which candidate they are of: equal e-mails and phones do."""
    return fuse(with_entity_keys(sources, cfg), cfg, config)


def is_pdf(path: str) -> bool:
    return path.lower().endswith(".pdf")


def run(spark: SparkSession, csv: str | None = None, resume: str | None = None, html: str | None = None, user: str | None = None, config: str | None = None, cfg: FusionConfig | None = None) -> DataFrame:
    """(candidate_key, json) of one candidate's files; a résumé is a PDF if its name says so, else text. A source that can't be read is logged and left out; without any, ValueError."""
    from braid.sources.api import read_users
    from braid.sources.html import read_html
    from braid.sources.pdf import read_pdf
    from braid.sources.resume import resume_profiles
    from braid.sources.tabular import read_csv

    readers: list[tuple[str, str | None, Callable[[str], DataFrame]]] = [
        ("csv", csv, lambda p: read_csv(spark, p, first_row_only=True)),
        ("resume", resume, lambda p: resume_profiles((read_pdf(spark, p) if is_pdf(p) else spark.read.text(p, wholetext=True).withColumnRenamed("value", "text")).filter("text is not null").withColumn("k", F.lit("1")), "k")),
        ("linkedin", html, lambda p: read_html(spark, p)),
        ("github", user, lambda p: read_users(spark, p)),
    ]
    sources = {}
    for name, path, read in readers:
        if not path or name != "github" and not os.path.exists(path):
            continue
        try:
            found = aligned(read(path), name).withColumn("candidate_key", F.lit("1"))
            rows = found.collect()  # one candidate: a row per source
            # an empty but readable source still counts
            sources[name] = spark.createDataFrame(rows or [("1", name, 0, *[None] * (len(found.columns) - 3))], found.schema)
        except Exception as e:  # noqa: BLE001  a source's failure must not stop the others
            log.error("%s can't be read: %s", name, e)
    if not sources:
        raise ValueError("No valid sources provided or all sources failed to extract.")
    for row in conflicts(normalized(unified(sources)), cfg).collect():
        log.warning("%s may describe someone else than %s does; merged anyway", row.source, row.anchor_source)
    return fuse_to_json(sources, cfg, load_config(config))
