"""Quality rules: decision lists learned by sequential covering, as ordered Spark conditional expressions.

Every text becomes a few shares. A rule is a conjunction of thresholds on them; it grows, condition by condition, by the
largest information gain on two thirds of the labelled documents, is pruned on the other third, and what it covers
is set aside before the next one grows. Each step is one sum of the labelled statistics by feature and bin; the driver
sees these sums alone, some hundred numbers however many documents are labelled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, texts

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_RULES, MAX_CONDITIONS, MIN_COVER, MIN_PRECISION = 12, 4, 5, 0.8
_CUTS = [i / 48 for i in range(1, 48)]

FEATURES = ["symbol_share", "shout_share", "upper_share", "digit_share", "repeat_share", "dup_line_share", "mean_word"]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base rule and the features. A null text has no words."""
    df = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    df = df.select("doc_id", "text", F.filter(F.split("text", _SPACE, -1), lambda x: x != "").alias("words"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("words")
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    df = df.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", _SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("_lines"),
        F.length("text").alias("_chars"),
        _count(F.col("text"), r"[!?]").alias("_shouts"),
        _count(F.col("text"), r"\p{Lu}").alias("_upper"),
        _count(F.col("text"), r"[0-9]").alias("_digits"),
        F.when(n >= 3, window).otherwise(F.array().cast("array<long>")).alias("_windows"),
    )
    # positions of windows that are found again, in order; texts without one take the short way
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    sorted_ = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(again, sorted_))
    twice = F.filter("_sorted", lambda x, k: (x["h"] == F.get("_sorted", k - 1)["h"]) | (x["h"] == F.get("_sorted", k + 1)["h"]))
    df = df.withColumn("_twice", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "_twice",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(3))).alias("n")),
        lambda acc: acc["n"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))

    def share(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "_chars").alias("symbol_share"), share("_shouts", "_chars").alias("shout_share"), share("_upper", "_chars").alias("upper_share"), share("_digits", "_chars").alias("digit_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("n_dup_lines", "_lines").alias("dup_line_share"), share("word_chars", "n_words").alias("mean_word"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float
    bin: int

    def holds(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def holds_binned(self) -> Column:
        return F.get("bins", F.lit(FEATURES.index(self.feature))) > self.bin if self.above else F.get("bins", F.lit(FEATURES.index(self.feature))) <= self.bin

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = list[Condition]


def _all(conditions: Rule, binned: bool) -> Column:
    out = F.lit(True)
    for c in conditions:
        out &= c.holds_binned() if binned else c.holds()
    return out


def _binned(rows: DataFrame) -> tuple[DataFrame, list[list[float]]]:
    """Rows with a bin for each feature, cut at quantiles of all rows and of the bad ones."""
    asked = [F.array_union(F.percentile_approx(f, _CUTS, 10000), F.percentile_approx(F.when(F.col("bad"), F.col(f)), _CUTS, 10000)).alias(f) for f in FEATURES]
    found = rows.agg(*asked).first()
    cuts = [sorted({float(x) for x in found[f] or []}) for f in FEATURES]

    def bin_of(f: str, own: list[float]) -> Column:
        """How many cuts lie below the value."""
        return F.size(F.filter(F.array(*(F.lit(x) for x in own)), lambda cut: cut < F.col(f))) if own else F.lit(0)

    bins = F.array(*(bin_of(f, own) for f, own in zip(FEATURES, cuts, strict=True)))
    return rows.select("bad", "grows", bins.alias("bins")), cuts


def _grow(rows: DataFrame, cuts: list[list[float]]) -> Rule:
    rule: Rule = []
    while len(rule) < MAX_CONDITIONS:
        now = rows.filter(_all(rule, True)).select("bad", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
        p0, n0 = (sum(r[k] for r in now if r["f"] == 0) for k in ("p", "n"))
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for f, own in enumerate(cuts):
            p = n = 0
            by_bin = {r["bin"]: r for r in now if r["f"] == f}
            for b, cut in enumerate(own):
                if b in by_bin:
                    p, n = p + by_bin[b]["p"], n + by_bin[b]["n"]
                for above, p1, n1 in ((False, p, n), (True, p0 - p, n0 - n)):
                    if p1 >= MIN_COVER:
                        g = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))
                        if g > gain:
                            best, gain = Condition(FEATURES[f], above, cut, b), g
        if best is None:
            break
        rule.append(best)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> Rule | None:
    """The rule's best beginning on rows it has not grown on; None if even that is not worth keeping."""
    found = rows.agg(*(F.count_if(_all(rule[: k + 1], True) & (F.col("bad") == bad)).alias(f"{k}_{int(bad)}") for k in range(len(rule)) for bad in (True, False))).first()
    best, worth = None, -1.0
    for k in range(len(rule)):
        p, n = found[f"{k}_1"], found[f"{k}_0"]
        if p and (p - n) / (p + n) > worth + 1e-9:
            best, worth = rule[: k + 1], (p - n) / (p + n)
    return best if worth >= 2 * MIN_PRECISION - 1 else None


def learn(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules for bad documents, in order. labels: doc_id and quality (0 bad, 1 good; repeated rows: their mean); nulls are not labels."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("quality is not null").groupBy("doc_id").agg((F.avg("quality") < 0.5).alias("bad"))
    rows = stats.select("doc_id", *FEATURES).join(known, "doc_id").withColumn("grows", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 0)
    rows, cuts = _binned(checkpoint(rows))
    rows = checkpoint(rows)
    rules: list[Rule] = []
    left = rows
    while len(rules) < MAX_RULES:
        rule = _grow(left.filter("grows"), cuts)
        rule = _prune(left.filter("not grows"), rule) if rule else None
        if not rule:
            break
        rules.append(rule)
        left = left.filter(~_all(rule, True))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that a document meets, from 1; 0: none, so it is kept."""
    out = F.when(F.lit(False), 0)
    for i, rule in enumerate(rules):
        out = out.when(_all(rule, False), i + 1)
    return out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: counts, base_failed, rule (number of the learned rule it falls under, 0 if none) and kept.

    Null and empty texts have no words and fail the base rule; repeated rows are judged each; without labels of both kinds there is no
    learned rule; an empty table gives an empty one; other columns are not looked at.
    """
    stats = checkpoint(statistics(docs))
    rules = learn(stats, labels)
    out = stats.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
