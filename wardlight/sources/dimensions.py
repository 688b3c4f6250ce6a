"""Dimension scans: application catalogue, SIEM rules, remediation documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import fixed_values as fv
from wardlight.schemas import CATALOGUE


def application_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of applications; ``ord`` is the list position."""
    text = spark.read.text(path, wholetext=True)
    items = text.select(F.posexplode(F.from_json("value", f"array<struct<{CATALOGUE.replace(' ', ':').replace(',:', ',')}>>"))
                        .alias("ord", "a"))
    return items.select("ord", "a.*")


def siem_rules(spark: SparkSession) -> DataFrame:
    """Rule id to event type, category and signal (12 fixed rows)."""
    return spark.createDataFrame(
        list(fv.SIEM_RULES), "rule_id string, rule_event_type string, shadow_it_category string, cert_signal string")


def remediation(spark: SparkSession, path: str) -> DataFrame:
    """Sections and fixes of every markdown document below ``path``."""
    return parse_remediation(spark.read.text(path, wholetext=True))


def parse_remediation(documents: DataFrame, text: str = "value") -> DataFrame:
    """One row per fix, in document order; sections without fixes keep one row.

    Documents are parsed in parallel, each within its row.
    """
    parts = F.split(F.col(text), r"(?m)^(?=## 9\.\d+ )")
    sections = documents.select(F.explode(parts).alias("part")).select(
        F.regexp_extract("part", fv.SECTION_HEADER, 1).alias("section_id"),
        F.trim(F.substring_index(F.regexp_extract("part", fv.SECTION_HEADER, 2), "—", 1))
        .alias("section_title"),
        F.col("part").alias("body")).where(F.col("section_id") != "")
    rx = F.lit(fv.FIX_ENTRY)
    zipped = F.arrays_zip(*[F.regexp_extract_all("body", rx, g).alias(n)
                            for g, n in ((1, "no"), (2, "title"), (3, "tier"))])
    return sections.select("section_id", "section_title", F.posexplode_outer(zipped).alias("ord", "f")).select(
        "section_id", "section_title", F.coalesce("ord", F.lit(0)).alias("ord"),
        F.col("f.no").cast("int").alias("fix_no"), F.trim("f.title").alias("fix_title"),
        F.trim("f.tier").alias("evidence_tier"))
