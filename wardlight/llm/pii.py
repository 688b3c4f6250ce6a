"""Operator 4: personal data by candidate spans and boosted trees, in DataFrame operations only.

Generators propose spans: the four plain patterns, valid or not, and looser forms of
them. Both are labelled by evidence: a check of the value (digits, checksum, groups,
ending of the domain), code or a URL around it, and for looser e-mails and phones
agreement with a valid plain value anywhere (same domain, same last nine digits). Trees
learn value and context from these; looser candidates whose margin passes a threshold,
calibrated per kind on looser candidates, are added to the valid plain ones. The
trees are read off the fitted model as column expressions, so scoring needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.stored import store

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98     # of held-out candidates above a kind's threshold
TREES, DEPTH = 10, 4
BLOCK = 256          # matches per partial sum of lengths
MARGIN_STEPS = 1024  # buckets of margins, to one

# Fixed patterns of the plain kinds. A start inside a run that cannot match is skipped
# by the look-behind, and quantifiers do not give back, so long runs cost linear time.
PLAIN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[(?i:at)\]|\((?i:at)\)|@) ?[A-Za-z0-9-]{1,63}"
             r"(?:(?: ?(?:\[(?i:dot)\]|\((?i:dot)\)) ?|\.| \. )[A-Za-z0-9-]{1,63}){1,6}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{4}){2,3}(?:[ ._/-]{1,2}[0-9]{1,3})?(?![0-9])",
    "phone": r"(?<![0-9+])(?:00|\()[0-9][\x20().0-9/-]{6,22}[0-9](?![0-9])",
}
_NEEDS = {"email": r"@|[\[(](?i:at)[\])]", "phone": r"[+(]|00"}
CUES = r"(?i)call|tel|phone|mobil|fax|mail|contact|reach|card|visa|account|pay|host|server|login|addr|\bip\b"
FEATURES = ("length", "digits", "letters", "separators", "runs", "longest", "cue", "before_word", "after_word", "line_start",
            "checks", "code")
CODE_BEFORE, CODE_AFTER = r"(?:://\S*|[/&?#\\$_@{]|\w\()$", r"^[\w/=({\[<\\&#]"
ENDINGS = "[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|dev|app|xyz|tech|cloud|shop|online|site"


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """All matches of a pattern: start, kind number, end, body and what stands before and after it."""
    def placed(m, pieces):
        steps = F.transform(pieces, lambda p, i: F.length(p) + F.when(i > 0, F.length(m[i - 1])).otherwise(0))

        def with_sums(s):
            count = F.ceil(F.size(s["steps"]) / BLOCK).cast("int")
            sums = F.transform(F.sequence(F.lit(0), count - 1), lambda b: _sum(F.slice(s["steps"], b * BLOCK + 1, F.lit(BLOCK))))
            return _bound(F.struct(s["steps"].alias("steps"), sums.alias("sums")), lambda t: F.transform(
                m, lambda body, i: _span(body, i, t)))

        def _span(body, i, t):
            block = F.floor(i / BLOCK).cast("int")
            start = _sum(F.slice(t["sums"], F.lit(1), block)) + _sum(
                F.slice(t["steps"], block * BLOCK + 1, i - block * BLOCK + 1))
            return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                            (start + F.length(body)).alias("end"), body.alias("body"),
                            F.right(pieces[i], F.lit(24)).alias("before"), F.left(pieces[i + 1], F.lit(1)).alias("after"))

        return _bound(F.struct(steps.alias("steps")), with_sums)

    empty = F.from_json(F.lit("[]"), "array<struct<start:int,kind:int,end:int,body:string,before:string,after:string>>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind in _NEEDS:
        matches = F.when(F.rlike(text, F.lit(_NEEDS[kind])), matches).otherwise(F.array().cast("array<string>"))
    return _bound(matches, lambda m: F.when(F.size(m) == 0, empty).otherwise(
        _bound(F.split(text, pattern, -1), lambda pieces: placed(m, pieces))))


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _valid(c: Column) -> Column:
    """Whether a plain candidate is one of the base kind."""
    n = F.length(_digits(c["body"]))
    octet = "^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
    ip = F.forall(F.split(c["body"], r"\."), lambda part: F.rlike(part, F.lit(octet)))
    card = n.between(14, 19) & F.when(n.between(14, 19), F.call_function("luhn_check", _digits(c["body"]))).otherwise(False)
    return F.when(c["kind"] == 0, True).when(c["kind"] == 1, ip).when(c["kind"] == 2, card).otherwise(n.between(10, 15))


def _normal(c: Column) -> Column:
    """The value of a candidate, alike for plain and looser forms."""
    email = F.regexp_replace(F.lower(c["body"]), r" ?(?:\[at\]|\(at\)|@) ?", "@")
    email = F.regexp_replace(email, r" ?(?:\[dot\]|\(dot\)|\.) ?", ".")
    return F.when(c["kind"] == 0, email).when(c["kind"] == 1, F.lower(c["body"])).when(
        c["kind"] == 2, _digits(c["body"])).otherwise(F.regexp_replace(_digits(c["body"]), "^00", ""))


def _checks(c: Column, normal: Column) -> Column:
    """Whether the value itself can be one of its kind."""
    spelled = F.lower(c["body"]) != normal   # a looser form needs a known ending
    email = F.rlike(normal, F.lit(r"\.[a-z]{2,24}$")) & (~spelled | F.rlike(normal, F.lit(rf"\.(?:{ENDINGS})$")))
    pairs = "^[0-9a-f]{2}(?::[0-9a-f]{2})+$"   # hardware addresses and times
    six = F.rlike(normal, F.lit("^(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$")) & ~F.rlike(normal, F.lit(pairs))
    return F.when(c["kind"] == 0, email).when((c["kind"] == 1) & F.contains(normal, F.lit(":")), six).when(
        c["kind"] < 3, _valid(c)).otherwise(F.length(normal).between(10, 15))


def _code(c: Column) -> Column:
    return F.rlike(c["before"], F.lit(CODE_BEFORE)) | F.rlike(c["after"], F.lit(CODE_AFTER))


def _key(c: Column, normal: Column) -> Column:
    """What an e-mail or phone shares with another form of it."""
    return F.when(c["kind"] == 0, F.substring_index(normal, "@", -1)).when(
        (c["kind"] == 3) & (F.length(normal) >= 9), F.right(normal, F.lit(9)))


def _features(c: Column, normal: Column) -> list[Column]:
    digits = F.length(_digits(normal))
    letters = F.length(F.regexp_replace(normal, "[^A-Za-z]", ""))
    runs = F.filter(F.split(normal, "[^0-9A-Za-z]+"), lambda x: x != "")
    flag = lambda x: x.cast("double")
    return [x.cast("double") for x in (
        F.length(normal), digits, letters, F.length(normal) - digits - letters, F.size(runs),
        F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)), flag(F.rlike(c["before"], F.lit(CUES))),
        flag(F.rlike(c["before"], F.lit(r"\w$"))), flag(F.rlike(c["after"], F.lit(r"^\w"))),
        flag(F.rlike(c["before"], F.lit(r"(^|\n)\s*$"))), flag(_checks(c, normal)), flag(_code(c)))]


@dataclass
class Trees:
    """A fitted model as nested conditions, and the margin a looser candidate of each kind needs."""

    roots: list
    weights: list[float]
    thresholds: dict[int, float]

    def margin(self, c: Column) -> Column:
        def grow(node, f):
            if len(node) == 1:
                return F.lit(node[0])
            at, cut, left, right = node
            return F.when(f[at] <= F.lit(cut), grow(left, f)).otherwise(grow(right, f))

        return _bound(_bound(_normal(c), lambda normal: F.array(*_features(c, normal), c["kind"].cast("double"))), lambda f: sum(
            (grow(root, f) * weight for root, weight in zip(self.roots, self.weights, strict=True)), F.lit(0.0)))


def _read(node) -> tuple:
    if node.numDescendants() == 0:
        return (node.prediction(),)
    return (node.split().featureIndex(), node.split().threshold(), _read(node.leftChild()), _read(node.rightChild()))


def _forms(text: Column, docs: DataFrame) -> DataFrame:
    """Every candidate of the plain and the looser patterns, in one pass over the texts."""
    def flagged(patterns, loose):
        return [F.transform(_spans(text, kind, patterns[kind]), lambda c: F.struct(c.alias("c"), F.lit(loose).alias("loose")))
                for kind in KINDS]

    found = docs.select(F.explode(F.concat(*flagged(PLAIN, False), *flagged(LOOSE, True))).alias("f")).select("f.*")
    normal = _normal(F.col("c"))
    return found.select("c", "loose", normal.alias("normal"), F.col("c.kind").alias("kind"), _key(F.col("c"), normal).alias("key"))


def _thresholds(judged: DataFrame, precision: float) -> dict[int, float]:
    """Per kind the lowest margin from which up the share of positive candidates is at least ``precision``.

    ``judged`` has kind, label, loose, train and raw, a row a labelled candidate. Candidates are counted per
    margin, and margins added up in buckets, so no kind meets in one task.
    """
    margins = judged.groupBy("kind", "loose", "train", "raw").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("right"))
    margins = store(judged.sparkSession, margins, "pii-margins")
    positive = {(r["kind"], r["loose"], r["train"]) for r in
                margins.filter("right > 0").select("kind", "loose", "train").distinct().collect()}   # at most 16 rows
    scopes = []
    for kind in range(len(KINDS)):
        held_out, loose = (kind, True, False) in positive, {(kind, True, False), (kind, True, True)} & positive
        scopes.append((F.col("kind") == kind) & (F.col("loose") & ~F.col("train") if held_out else F.col("loose") if loose else F.lit(True)))
    held = margins.filter(reduce(or_, scopes)).groupBy("kind", "raw").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    held = held.withColumn("bucket", F.floor(F.col("raw") * MARGIN_STEPS))
    totals = held.groupBy("kind", "bucket").agg(F.sum("n").alias("_n"), F.sum("right").alias("_right"))
    above = Window.partitionBy("kind").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("kind", "bucket", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("_n", "_right")))
    inside = Window.partitionBy("kind", "bucket").orderBy(F.desc("raw"))
    seen, right = (F.sum(c).over(inside) + F.col(f"_{c}") for c in ("n", "right"))
    share = held.join(totals, ["kind", "bucket"]).select("kind", "raw", (right / seen).alias("share"))
    # The column expression may add the trees in another order.
    return {r["kind"]: r["raw"] - 1e-9 for r in share.filter(F.col("share") >= precision).groupBy("kind").agg(F.min("raw").alias("raw")).collect()}


def fit(docs: DataFrame, precision: float = PRECISION, text_col: str = "text") -> Trees | None:
    """Trees and thresholds from all plain and looser candidates of all texts, labelled by evidence.

    A candidate that fails its check or stands in code or a URL is
    negative; one that passes is positive if it is plain, an address or a card, or agrees
    with a plain value of any document; others have no label and are only judged. Values of one
    half are fitted; a kind is calibrated on the looser candidates of the other half, or on all
    its labelled looser ones where that half has none of them positive. A kind without a positive
    looser candidate has the lowest threshold of its plain ones. None where the fitted half lacks a label.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    forms = store(spark, _forms(text, docs), "pii-forms")
    c, normal = F.col("c"), F.col("normal")
    keyed = forms.filter("key IS NOT NULL")
    wanted = keyed.filter("loose").select("kind", "key").distinct()
    plain = keyed.filter(~F.col("loose") & _valid(c)).select("kind", "key").distinct()
    agreed = plain.join(wanted, ["kind", "key"], "left_semi").withColumn("agrees", F.lit(True))
    # Plain candidates, addresses and cards need no agreement, so they pass by the join.
    asks = F.col("loose") & F.col("key").isNotNull()
    both = forms.filter(asks).join(agreed, ["kind", "key"], "left").select(*forms.columns, "agrees").unionByName(
        forms.filter(~asks).withColumn("agrees", F.lit(None).cast("boolean")))
    sure = ~F.col("loose") | F.col("kind").isin(1, 2) | F.col("agrees")
    label = F.when(~_checks(c, normal) | _code(c), 0.0).when(sure, 1.0)
    rows = both.select(
        label.alias("label"), "kind", "loose", (F.xxhash64("kind", "normal") % 2 == 0).alias("train"),
        *[f.alias(name) for f, name in zip(_features(c, normal), FEATURES, strict=True)]).filter("label IS NOT NULL")
    rows = store(spark, rows.withColumn("kind_number", F.col("kind").cast("double")), "pii-candidates")
    if rows.filter("train").select("label").distinct().count() < 2:
        return None
    vector = VectorAssembler(inputCols=[*FEATURES, "kind_number"], outputCol="features")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7).fit(vector.transform(rows.filter("train")))
    judged = model.transform(vector.transform(rows)).select(
        "kind", "label", "loose", "train", vector_to_array("rawPrediction")[1].alias("raw"))
    thresholds = _thresholds(judged, precision)
    trees = model._java_obj.trees()
    return Trees([_read(trees[i].rootNode()) for i in range(len(trees))], list(model._java_obj.treeWeights()), thresholds)


def find_personal_data(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans, arrays of (start, kind, end), by start, then kind.

    Positions are code points of the whole text, end exclusive; kind is a position in
    KINDS. base holds the valid plain spans, spans these and the looser candidates that
    pass their check, stand outside code and URLs, are accepted by the trees and touch no base span. A null or empty text has none; repeated
    rows and null ids are treated like any other; extra columns are not read; an empty
    table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    brief = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    base = F.concat(*(F.filter(_spans(text, kind, PLAIN[kind]), _valid) for kind in KINDS))
    found = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.array_sort(F.transform(base, brief)).alias("base"),
                        _loose(text, trees).alias("loose"))
    apart = F.filter("loose", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return found.select(id_col, "base", F.array_sort(F.concat("base", F.transform(apart, brief))).alias("spans"))


def _loose(text: Column, trees: Trees | None) -> Column:
    kinds = [kind for kind in KINDS if trees and KINDS.index(kind) in trees.thresholds]
    if not kinds:
        return F.from_json(F.lit("[]"), "array<struct<start:int,kind:int,end:int>>")

    def accepted(kind):
        return lambda c: _bound(_normal(c), lambda normal: _checks(c, normal)) & ~_code(c) & (
            trees.margin(c) >= F.lit(trees.thresholds[KINDS.index(kind)]))

    return F.concat(*(F.filter(_spans(text, kind, LOOSE[kind]), accepted(kind)) for kind in kinds))
