"""Detection quality against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight import fixed_values as fv
from wardlight.operators.ranking import hash_bucket, numbered, running_before, value_ranks


def with_metrics(df: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp and fn; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return (df.withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall")
                                     / (F.col("precision") + F.col("recall"))).otherwise(0.0)))


def confusion(flagged: Column, actual: Column) -> list[Column]:
    return [F.count_if(flagged & actual).alias("tp"), F.count_if(flagged & ~actual).alias("fp"),
            F.count_if(~flagged & actual).alias("fn")]


def rank_auc(df: DataFrame, score: str, label: str, keys=()) -> DataFrame:
    """Area under the curve (ties half), class sizes and class means, per key.

    Works on (value, count) rows; the scored rows are not sorted as a whole.
    """
    keys = list(keys)
    ranked = value_ranks(df, score, keys, [F.sum(F.col(label).cast("long")).alias("n_pos")])
    rank_sum = F.sum(F.col("n_pos") * (F.col("n_before") + (F.col("n_equal") + 1) / 2))
    n_neg = F.col("n_equal") - F.col("n_pos")
    grouped = ranked.groupBy(*keys).agg(
        rank_sum.alias("_r"), F.sum("n_pos").alias("n_pos"), F.sum(n_neg).alias("n_neg"),
        F.sum(F.col(score) * F.col("n_pos")).alias("_sp"), F.sum(F.col(score) * n_neg).alias("_sn"))
    pos, neg = F.col("n_pos"), F.col("n_neg")
    auc = F.when((pos > 0) & (neg > 0), (F.col("_r") - pos * (pos + 1) / 2) / (pos * neg))
    return grouped.select(*keys, auc.alias("auc"), "n_pos", "n_neg",
                          (F.col("_sp") / F.nullif(pos, F.lit(0))).alias("mean_pos"),
                          (F.col("_sn") / F.nullif(neg, F.lit(0))).alias("mean_neg"))


def _sweep(df: DataFrame, score: str, label: str, source: str, with_cuts) -> DataFrame:
    """Counts and metrics per cutoff; ``with_cuts`` adds the sorted cutoffs as ``_cuts``.

    Each row is mapped to the number of cutoffs it reaches and counted there;
    the cutoffs are expanded on those few counts, not on the rows.
    """
    reached = F.size(F.filter("_cuts", lambda c: c <= F.col(score)))
    counts = with_cuts(df.select(score, label, source)).groupBy(source, reached.alias("_reached")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_pos"))
    wide = with_cuts(counts).select(
        source, "_reached", "_n", "_pos", F.posexplode("_cuts").alias("_i", "cutoff"))
    on = F.col("_i") < F.col("_reached")
    sets = wide.groupingSets([["cutoff"], ["cutoff", source]], "cutoff", source).agg(
        F.sum(F.when(on, F.col("_n")).otherwise(0)).alias("flagged"),
        F.sum(F.when(on, F.col("_pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(on, F.col("_n") - F.col("_pos")).otherwise(0)).alias("fp"),
        F.sum(F.when(on, F.lit(0)).otherwise(F.col("_pos"))).alias("fn"),
        F.grouping(source).alias("_all"))
    return with_metrics(sets.withColumn(
        source, F.when(F.col("_all") == 1, "(all)").otherwise(F.col(source))).drop("_all"))


def cutoff_sweep(df: DataFrame, score: str, label: str, cutoffs, source: str = "_source") -> DataFrame:
    """Counts and metrics at each fixed cutoff, over all rows and per source."""
    cuts = F.array(*[F.lit(c) for c in sorted(set(float(c) for c in cutoffs))])
    return _sweep(df, score, label, source, lambda d: d.withColumn("_cuts", cuts))


def _neighbours(df: DataFrame, score: str) -> DataFrame:
    """Distinct scores (6 digits) with the next larger one: v, i (its place), n (the last place), next_v."""
    distinct = df.select(F.round(score, 6).alias("v")).where(F.col("v").isNotNull()).distinct()
    ranked = value_ranks(distinct, "v").select("v", F.col("n_before").alias("i"),
                                               (F.col("n_total") - 1).alias("n"))
    return ranked.join(ranked.select((F.col("i") - 1).alias("i"), F.col("v").alias("next_v")), "i")


def observed_cutoffs(df: DataFrame, score: str, keep: int | None = None) -> DataFrame:
    """Midpoints between neighbouring observed scores (6 digits); ``keep`` thins a printed table to about that many."""
    found = _neighbours(df, score)
    if keep is not None:
        step = F.when(F.col("n") > keep, F.floor(F.col("n") / keep)).otherwise(1)
        found = found.where(F.pmod(F.col("i"), step) == 0)
    return found.select(((F.col("v") + F.col("next_v")) / 2).alias("cutoff"))


def observed_sweep(df: DataFrame, score: str, label: str, source: str = "_source", keep: int = 15) -> DataFrame:
    """A table to read, the sweep on about ``keep`` to twice as many observed cutoffs, held in one small row.

    The best cutoffs are not taken from it but from all of them: :func:`best_observed_cutoffs`.
    """
    cuts = observed_cutoffs(df, score, keep).agg(F.sort_array(F.collect_list("cutoff")).alias("cuts"))
    return _sweep(df, score, label, source, lambda d: d.withColumn("_cuts", cuts.scalar()))


def best_observed_cutoffs(df: DataFrame, score: str, label: str, source: str = "_source", min_bad: int = 3) -> DataFrame:
    """Best of all observed cutoffs by f1, overall and per source with enough bad rows; the lowest on ties.

    A source's counts change only above its own scores, so each (source, score) stands for
    the lowest cutoff above it, and running sums over these pairs replace a sweep. The lowest score
    of all counts for every source, as its cutoff may lie below all of the source's own.
    """
    bad = F.col(label).cast("long")
    sets = df.select(F.round(score, 6).alias("v"), F.col(source).alias("_scope"), bad.alias("_bad"))
    sets = sets.groupingSets([["v"], ["v", "_scope"]], "v", "_scope").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_bad").alias("pos"), F.grouping("_scope").alias("_all"))
    counts = sets.select(F.when(F.col("_all") == 1, "(all)").otherwise(F.col("_scope")).alias(source), "v", "n", "pos")
    known = F.col("v").isNotNull()
    totals = counts.groupBy(source).agg(
        F.sum("pos").alias("n_bad"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("n_all"),
        F.sum(F.when(known, F.col("pos")).otherwise(0)).alias("pos_all"))
    lowest = counts.agg(F.min("v")).scalar()
    start = totals.select(source, lowest.alias("v"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"))
    steps = counts.where(known).unionByName(start).groupBy(source, "v").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    steps = steps.withColumn("_at", F.round(F.col("v") * 1e6).cast("long"))
    sums = running_before(steps, [source], "_at", 1 << 12, {"n_below": F.col("n"), "pos_below": F.col("pos")})
    cutoff = ((F.col("v") + F.col("next_v")) / 2).alias("cutoff")
    tp = F.col("pos_all") - F.col("pos_below") - F.col("pos")
    flagged = F.col("n_all") - F.col("n_below") - F.col("n")
    found = sums.join(totals, source).join(_neighbours(df, score).select("v", "next_v"), "v").select(
        source, cutoff, tp.alias("tp"), (flagged - tp).alias("fp"), (F.col("n_bad") - tp).alias("fn"))
    return best_cutoffs(with_metrics(found), source, min_bad)


def best_cutoffs(sweep: DataFrame, source: str = "_source", min_bad: int = 3) -> DataFrame:
    """The row of highest f1, overall and for sources with enough bad rows; the lowest cutoff on ties."""
    usable = sweep.where((F.col("f1") > 0) & ((F.col(source) == "(all)") | (F.col("tp") + F.col("fn") >= min_bad)))
    pick = F.max_by(F.struct("cutoff", "f1", "precision", "recall"),
                    F.struct(F.col("f1"), -F.col("cutoff")))
    return usable.groupBy(source).agg(pick.alias("b")).select(source, "b.*")


def day_evaluation(scored: DataFrame, source: str = "_source") -> DataFrame:
    """High and Critical days against bad days, over all and per source, in one GROUPING SETS."""
    flagged = F.col("risk_category").isin(*fv.FLAGGED_CATEGORIES)
    actual = F.col("daily_labeled_anomaly_count") > 0
    sets = scored.groupingSets([[], [source]], source).agg(
        F.count(F.lit(1)).alias("n_days"), F.count_if(actual).alias("n_bad"), *confusion(flagged, actual),
        F.grouping(source).alias("_all"))
    return with_metrics(sets.withColumn(
        source, F.when(F.col("_all") == 1, "(all)").otherwise(F.col(source))).drop("_all"))


def model_report(predictions: DataFrame, source: str = "_source", keep=lambda df, name: df) -> DataFrame:
    """E5: per model, overall and per source: precision, recall, f1 and AUC.

    Input: model, ``source``, label, prediction, probability. A source needs
    five rows and one positive. The predictions are read three times; ``keep`` stores them, so that they are made once.
    """
    predictions = keep(predictions.select("model", source, "label", "prediction", "probability"), "predictions")
    flagged, actual = F.col("prediction") == 1, F.col("label") == 1
    sets = predictions.groupingSets([["model"], ["model", source]], "model", source).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(actual).alias("n_bad"), *confusion(flagged, actual),
        F.grouping(source).alias("_all"))
    named = sets.withColumn("scope", F.when(F.col("_all") == 1, "(all)").otherwise(F.col(source)))
    named = with_metrics(named.where((F.col("_all") == 1) | ((F.col("n") >= 5) & (F.col("n_bad") > 0))))
    overall = rank_auc(predictions, "probability", "label", ["model"]).select(
        "model", F.lit("(all)").alias("scope"), "auc")
    by_source = rank_auc(predictions, "probability", "label", ["model", source]).select(
        "model", F.col(source).alias("scope"), "auc")
    report = named.join(overall.unionByName(by_source), ["model", "scope"], "left")
    return report.select("model", "scope", "n", "n_bad", "tp", "fp", "fn",
                         *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1", "auc")])


def best_model(report: DataFrame, heuristic_auc: float = fv.HEURISTIC_EVENT_AUC) -> DataFrame:
    """The model of the highest overall AUC and whether it beats the heuristic."""
    overall = report.where(F.col("scope") == "(all)")
    return overall.agg(F.max_by("model", F.struct("auc", "model")).alias("model"),
                       F.max("auc").alias("auc")).withColumn("beats_heuristic", F.col("auc") > heuristic_auc)


def split_users(rows: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Per user and source, ``is_test``; stratified by source and by having an anomaly.

    Each stratum gives max(1, round(n * test_size)) users of lowest hash, none
    when it has a single user. Users are numbered through hash buckets.
    """
    users = rows.groupBy("_source", "_username").agg(F.max("_label").alias("has_anomaly"))
    hashed = users.withColumn("_h", F.xxhash64("_username", F.lit(seed)))
    placed = numbered(hashed, ["_source", "has_anomaly"], ["_h", "_username"], hash_bucket("_h"))
    n_test = F.when(F.col("n_rows") > 1, F.greatest(F.lit(1), F.bround(F.col("n_rows") * test_size))).otherwise(0)
    return placed.select("_source", "_username", "has_anomaly", (F.col("position") < n_test).alias("is_test"))


def train_test(rows: DataFrame, split: DataFrame):
    """(train, test) rows; no user is in both."""
    test_users = split.where("is_test").select("_source", "_username")
    keys = ["_source", "_username"]
    return rows.join(test_users, keys, "left_anti"), rows.join(test_users, keys, "left_semi")


def held_out_gap(scored: DataFrame, split: DataFrame) -> DataFrame:
    """Metrics on all days, on held-out users and on the others, in one pass."""
    marked = scored.join(split.select("_source", "_username", "is_test"), ["_source", "_username"], "left")
    parts = F.array(F.lit("all"), F.when(F.coalesce("is_test", F.lit(False)), "held_out").otherwise("train"))
    flagged = F.col("risk_category").isin(*fv.FLAGGED_CATEGORIES)
    actual = F.col("daily_labeled_anomaly_count") > 0
    return with_metrics(marked.select("*", F.explode(parts).alias("part")).groupBy("part").agg(
        F.count(F.lit(1)).alias("n_days"), *confusion(flagged, actual)))


def scenario_days(events: DataFrame) -> DataFrame:
    """Distinct (user, day, scenario) of labelled scenarios."""
    scenario = F.col("raw_data.scenario_id")
    return (events.where(scenario.isNotNull() & ~scenario.isin("", "None"))
            .select(F.col("username").alias("_username"), F.to_date("timestamp").alias("date"),
                    scenario.alias("scenario_id"), F.col("raw_data.threat_scenario").alias("threat_scenario"))
            .dropDuplicates(["_username", "date", "scenario_id"]))


def scored_scenario_days(scored: DataFrame, scenarios: DataFrame, casb_source: str) -> DataFrame:
    """Bad CASB days with each scenario of the day, and whether the day was flagged."""
    days = scored.where((F.col("_source") == casb_source) & (F.col("daily_labeled_anomaly_count") > 0))
    return days.join(scenarios, ["_username", "date"], "left").withColumn(
        "flagged", F.col("risk_category").isin(*fv.FLAGGED_CATEGORIES))


def scenario_recall(joined: DataFrame) -> DataFrame:
    """Days, caught, missed and recall per scenario."""
    counts = joined.where(F.col("scenario_id").isNotNull()).groupBy("scenario_id", "threat_scenario").agg(
        F.count(F.lit(1)).alias("total_days"), F.count_if("flagged").alias("caught"))
    return counts.select("*", (F.col("total_days") - F.col("caught")).alias("missed"),
                         (F.col("caught") / F.col("total_days")).alias("recall"))


def missed_days(joined: DataFrame) -> DataFrame:
    """The bad days that were not flagged."""
    return joined.where(~F.col("flagged"))
