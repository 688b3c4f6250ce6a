"""Operator 12: learned decision lists for text quality, in DataFrame operations only.

Statistics of whole texts are column expressions. Sequential covering learns from labelled
statistics: a rule grows by the threshold condition of highest information gain,
found from one grouped histogram a step; it is pruned to the prefix that does
best on rows set apart; rows it covers leave, and the next rule follows. The list is
one ordered conditional expression, so judging a document needs neither shuffle nor Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.stored import discard, store

SAMPLE = 50_000     # labelled rows to learn from, at most, chosen by a hash of their id
CUTS = 32           # quantiles of each class that thresholds are taken from
CONDITIONS = 4      # in a rule, at most
RULES = 16          # at most
PRECISION = 0.9     # of a rule on the rows set apart
LEAST = 5           # rows of the class that a rule must cover, in both parts

# Fixed values of the base rule and its counts.
LEAST_WORDS, MOST_REPEATED = 50, 50   # words, percent of the words
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals",
          "n_marks", "n_digits")
FEATURES = ("n_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "capitals", "marks", "digits", "line_words")


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """How many words stand in windows of three that occur twice or more.

    Windows are compared by a 64-bit hash within the text (two of a million differ unnoticed
    once in 30 million texts of that length).
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(sorted_):
        def shared(x, i):
            return F.equal_null(F.get(sorted_, i - 1)["h"], x["h"]) | F.equal_null(F.get(sorted_, i + 1)["h"], x["h"])

        starts = F.sort_array(F.transform(F.filter(sorted_, shared), lambda x: x["i"]))
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(starts, zero, lambda a, x: F.struct(
            x.alias("last"), (a["total"] + F.least(F.lit(3), x - a["last"])).alias("total")), lambda a: a["total"])

    def count(h):
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_bound(ordered, covered))

    return F.when(F.size(words) < 4, 0).otherwise(_bound(windows, count))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of every whole text, one row per row of ``docs``.

    A null or empty text has zeros throughout. Words are runs without blanks, lines are cut at
    line feeds and count if they hold a word. Repeated rows and null ids are counted like any
    other; extra columns are not read; a very long text is one row's arrays.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))

    def without(pattern):
        return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))

    of_words = _bound(words, lambda w: F.struct(
        F.size(w).alias("n_words"), _repeated(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("n_distinct")))
    of_lines = _bound(lines, lambda x: F.struct(
        F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    found = docs.select(
        F.col(id_col).cast("bigint").alias(id_col), of_words.alias("w"), of_lines.alias("l"),
        F.length(F.regexp_replace(text, BLANK, "")).alias("word_chars"), without(SYMBOLS).alias("n_symbols"),
        without(r"\p{Lu}+").alias("n_capitals"), without(r"\p{P}+").alias("n_marks"), without(r"\p{Nd}+").alias("n_digits"))
    return found.select(id_col, "w.*", "l.*", "word_chars", "n_symbols", "n_capitals", "n_marks", "n_digits").select(
        id_col, *(F.col(name).cast("bigint") for name in COUNTS))


def base_failed() -> Column:
    """Whether the counts fail the base rule."""
    return (F.col("n_words") < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED) * F.col("n_words"))


def features() -> dict[str, Column]:
    """Shares that conditions are put on, 0 where there is nothing to divide by."""
    def share(part, whole):
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    values = (F.col("n_words").cast("double"), share("word_chars", "n_words"), share("n_symbols", "n_words"),
              share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_distinct", "n_words"),
              share("n_capitals", "word_chars"), share("n_marks", "word_chars"), share("n_digits", "word_chars"),
              share("n_words", "n_lines"))
    return dict(zip(FEATURES, values, strict=True))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self, values: dict[str, Column]) -> Column:
        value = values[self.feature]
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)

    def __str__(self):
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


@dataclass(frozen=True)
class Rule:
    """All conditions together; covered and right are rows set apart that it covered and got right."""

    conditions: tuple[Condition, ...]
    covered: int
    right: int

    def column(self, values: dict[str, Column]) -> Column:
        found = F.lit(True)
        for condition in self.conditions:
            found = found & condition.column(values)
        return found

    def __str__(self):
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, all for the class ``label``; what none covers has the other class."""

    rules: tuple[Rule, ...]
    label: int

    def verdict(self, values: dict[str, Column] | None = None) -> Column:
        """1 (good) or 0."""
        values = values or features()
        return self._list(values, lambda rule: F.lit(self.label), F.lit(1 - self.label))

    def rule_number(self, values: dict[str, Column] | None = None) -> Column:
        """Position of the first rule that covers the row, from 1; 0 where none does."""
        values = values or features()
        numbers = {rule: i + 1 for i, rule in enumerate(self.rules)}
        return self._list(values, lambda rule: F.lit(numbers[rule]), F.lit(0))

    def _list(self, values, result, default):
        if not self.rules:
            return default
        chain = F
        for rule in self.rules:
            chain = chain.when(rule.column(values), result(rule))
        return chain.otherwise(default)


def _gain(p: int, n: int, all_p: int, all_n: int) -> float:
    """Information gained on the covered rows of the class."""
    return p * (log2(p / (p + n)) - log2(all_p / (all_p + all_n))) if p else 0.0


def _best_condition(rows: DataFrame, cuts: dict[str, list[float]], label: int):
    """The condition of highest gain on the rows of the growing part, or None; one grouped count."""
    bins = rows.select("label", F.posexplode(F.array(*(F.col(f"bin_{name}") for name in FEATURES))).alias("feature", "bin"))
    counts: dict = {}
    for row in bins.groupBy("feature", "bin", "label").count().collect():   # features x cuts x 2 rows at most
        counts.setdefault(row.feature, {}).setdefault(row.bin, [0, 0])[row.label == label] += row["count"]
    best = None
    for number, name in enumerate(FEATURES):
        own = counts.get(number, {})
        all_n, all_p = (sum(c[i] for c in own.values()) for i in (0, 1))
        below = [0, 0]
        for at, cut in enumerate(cuts[name]):
            below = [a + b for a, b in zip(below, own.get(at, (0, 0)), strict=True)]
            for above, (n, p) in ((False, below), (True, (all_n - below[0], all_p - below[1]))):
                gain = _gain(p, n, all_p, all_n)
                if p >= LEAST and n < all_n and (best is None or (gain, p) > best[0]):
                    best = (gain, p), Condition(name, above, cut), n
    return best if best and best[0][0] > 1e-9 else None


def learn(labelled: DataFrame, cuts_each: int = CUTS, precision: float = PRECISION, rules: int = RULES) -> DecisionList:
    """A decision list from counts with ``label`` (0 or 1) and ``grow`` (true: rules grow on it, false: set apart).

    The list is for the rarer class (0 where both are equal). Thresholds lie midway between quantiles of both classes. A rule
    needs ``precision`` on the rows set apart that no earlier rule covers; the first that misses it
    ends the list. Without rows of both classes the list is empty and says the class there is (1 without rows).
    """
    values = features()
    totals = {row.label: row["count"] for row in labelled.groupBy("label").count().collect()}
    if len(totals) < 2:
        return DecisionList((), 1 - next(iter(totals), 1))
    label = 0 if totals[0] <= totals[1] else 1
    rows = labelled.select("label", "grow", *(value.alias(name) for name, value in values.items()))
    shares = F.lit([i / cuts_each for i in range(cuts_each)])
    quantiles = rows.filter("grow").groupBy("label").agg(*(F.percentile(name, shares).alias(name) for name in FEATURES)).collect()
    seen = {name: sorted({value for row in quantiles for value in row[name]}) for name in FEATURES}
    cuts = {name: [(a + b) / 2 for a, b in pairwise(found)] for name, found in seen.items()}

    def position(name):   # number of cuts below the value
        return F.size(F.filter(F.lit(cuts[name]), lambda cut: F.col(name) > cut)) if cuts[name] else F.lit(0)

    left = store(labelled.sparkSession, rows.select("*", *(position(name).alias(f"bin_{name}") for name in FEATURES)), "quality-rows")
    columns, table, found = {name: F.col(name) for name in FEATURES}, left, []
    while len(found) < rules:
        grown, covered = [], left.filter("grow")
        while len(grown) < CONDITIONS:
            best = _best_condition(covered, cuts, label)
            if best is None:
                break
            grown.append(best[1])
            covered = covered.filter(best[1].column(columns))
            if best[2] == 0:
                break
        if not grown:
            break
        prefixes = [Rule(tuple(grown[:i + 1]), 0, 0) for i in range(len(grown))]
        apart = left.filter("NOT grow").agg(*(F.count_if(prefix.column(columns) & hit).alias(f"{kind}{i}")
                                              for i, prefix in enumerate(prefixes)
                                              for kind, hit in (("n", F.lit(True)), ("p", F.col("label") == label)))).first()
        judged = [Rule(prefix.conditions, apart[f"n{i}"], apart[f"p{i}"]) for i, prefix in enumerate(prefixes)]
        rule = max(judged, key=lambda r: ((2 * r.right - r.covered) / r.covered if r.covered else -1.0, r.right))
        if rule.right < LEAST or rule.right < precision * rule.covered:
            break
        found.append(rule)
        left = left.filter(~rule.column(columns))
    discard(table)
    return DecisionList(tuple(found), label)


def fit(counts: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id") -> DecisionList:
    """A decision list from the counts of labelled rows that pass the base rule.

    ``labels`` has doc_id and quality; an id with several rows counts as good if one says so, null and
    other values are no label. At most ``sample`` rows, those of lowest hash of id; two thirds of the ids
    grow rules, one third is set apart.
    """
    marks = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(
        F.col("doc_id").cast("bigint").alias(id_col)).agg(F.max("quality").cast("int").alias("label"))
    hashed = F.xxhash64(F.col(id_col), F.lit(12))
    chosen = counts.filter(~base_failed()).join(marks, id_col).withColumn("h", hashed).orderBy("h", *COUNTS).limit(sample)
    chosen = store(counts.sparkSession, chosen.withColumn("grow", F.pmod("h", F.lit(3)) != 0), "quality-labelled")
    learned = learn(chosen)
    discard(chosen)
    return learned


def judge(counts: DataFrame, rules: DecisionList) -> DataFrame:
    """The counts with base_failed, kept, and rule: the number of the rule that covers a row that passes the base rule, else 0."""
    kept = ~base_failed() & (rules.verdict() == 1)
    return counts.select("*", base_failed().alias("base_failed"), kept.alias("kept"),
                         F.when(base_failed(), 0).otherwise(rules.rule_number()).alias("rule"))
