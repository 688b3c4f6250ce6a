"""Application catalogue lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.functions.text import catalogue_key


def domain_suffixes(key: str) -> str:
    """SQL: ``a.b.c`` as [a.b.c, b.c, c]."""
    parts = f"split({key}, '[.]')"
    return (f"transform(sequence(1, size({parts})), "
            f"i -> array_join(slice({parts}, i, size({parts})), '.'))")


def apps_of_domains(domains: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue row of each distinct domain; exact or dot-suffix, first row wins.

    Suffixes turn the test into an equi join. Each domain is looked up once,
    however many events carry it.
    """
    distinct = domains.select("domain").where(F.col("domain").isNotNull()).distinct()
    suffixes = (distinct.withColumn("_key", catalogue_key("domain")).where(F.col("_key") != "")
                .select("domain", F.explode(F.expr(domain_suffixes("_key"))).alias("_suffix")))
    hits = suffixes.join(catalogue.withColumnRenamed("domain", "_suffix"), "_suffix")
    best = hits.groupBy("domain").agg(F.min_by(
        F.struct("ord", "name", "category", "approval_state", "risk_weight"), "ord").alias("app"))
    return best.select("domain", "app.*")


def apps_of_publishers(publishers: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue row of each distinct publisher name."""
    def norm(c):
        return F.lower(F.trim(c))

    distinct = publishers.select("publisher").where(F.col("publisher").isNotNull()).distinct()
    entries = catalogue.where(F.col("publisher").isNotNull()).select(
        norm("publisher").alias("_p"), "ord", "name", "category", "approval_state", "risk_weight")
    hits = distinct.withColumn("_p", norm("publisher")).join(entries, "_p")
    best = hits.groupBy("publisher").agg(F.min_by(
        F.struct("ord", "name", "category", "approval_state", "risk_weight"), "ord").alias("app"))
    return best.select("publisher", "app.*")


def _looked_up(rows: DataFrame, key: str, apps: DataFrame, out: str) -> DataFrame:
    """``rows`` with the struct of ``apps`` (key, out) as ``out``; rows without a key pass by the join.

    Most events have no domain, so a plain left join would shuffle them all to the task of the NULL key.
    """
    keyed = rows.where(F.col(key).isNotNull()).join(apps, key, "left").select(*rows.columns, out)
    missing = F.lit(None).cast(apps.schema[out].dataType).alias(out)
    return keyed.unionByName(rows.where(F.col(key).isNull()).select(*rows.columns, missing))


def with_app(events: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Events with an ``app`` struct, NULL when the catalogue has no match.

    With both a domain and a publisher the lower catalogue position wins.
    """
    fields = ["ord", "name", "category", "approval_state", "risk_weight"]
    joined = _looked_up(events, "domain", apps_of_domains(events, catalogue).select("domain", F.struct(*fields).alias("_d")), "_d")
    app = F.col("_d")
    if "publisher" in events.columns:
        by_publisher = apps_of_publishers(events, catalogue).select("publisher", F.struct(*fields).alias("_p"))
        joined = _looked_up(joined, "publisher", by_publisher, "_p")
        app = F.least("_d", "_p")
    return joined.select(*events.columns, app.alias("app"))
