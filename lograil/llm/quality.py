"""Quality rules whose cutoffs are controlled by exact binomial bounds, native.

Each rule rejects documents whose measure lies above a cutoff of a fixed grid. The cutoffs of all rules form one chain of ever larger sets of rejected documents: the most
lenient cutoff of each rule in turn, then the next of each, and so on. For each stratum, the labelled good documents that a step of the chain rejects are counted, and steps are
tested from the first on: a step is admitted if the exact binomial tail P(X <= rejected | good, max_false) is at most the significance level divided by the number of
strata (Bonferroni). The sets are nested, so one chain needs no correction for its length: the first step whose true rate is at least max_false is admitted with that probability at most.
All rules together then falsely reject less than max_false of each stratum's good documents, for all strata at once, at the significance level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lograil.llm.common import SPACES, materialize, words_of

SYMBOLS = "#*$%&|<>"
#: Measure and cutoffs of each rule.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5),
    "dup_line_share": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7, 0.9),
    "repeat_share": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5),
    "upper_share": (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "mean_word_chars": (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0, 50.0),
}
#: Steps of the chain: a level is one cutoff of each rule, the most lenient first.
STEPS = len(RULES) * max(map(len, RULES.values()))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper) of every row. A null text has no words."""
    d = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.withColumns({"words": words_of(F.col("text")), "lines": F.filter(F.split("text", "\n", -1), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)})
    n = F.size("words")
    windows = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, 3)))
    d = d.withColumn("windows", F.when(n >= 3, windows))
    # Only texts with a repeated window are sorted.
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("ordered", F.when(F.size("windows") > F.size(F.array_distinct("windows")), ordered))
    twice = F.filter("ordered", lambda x, j: F.coalesce(F.get("ordered", j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("ordered", j + 1)["h"] == x["h"], F.lit(False)))
    d = d.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.zip_with("starts", F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    strip = lambda chars: (F.length("text") - F.length(F.translate("text", chars, ""))).cast("long")
    return d.select(
        "id", "stratum", n.cast("long").alias("n_words"), (F.length("text") - strip(SPACES)).alias("word_chars"), strip(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), strip("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
    )


def rule_values() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"), "mean_word_chars": share("word_chars", "n_words"),
    }


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1, by Stirling's series at x + 10."""
    y = x + 10
    product = F.lit(0.0)
    for i in range(10):
        product = product + F.log(x + i)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - product


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), or a little more; 1 where that is no small probability.

    Below the mean, terms shrink from the k-th down by the ratio r = k (1 - p) / ((n - k + 1) p) or faster. So many are summed that the others together are under rounding,
    and the geometric bound of those is added, so the sum is never too small. Within a standard deviation of the mean the tail is over a tenth; for large k it is given as 1 there.
    """
    kd, nd = k.cast("double"), n.cast("double")
    last = log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p))
    r = kd * (1 - p) / ((nd - kd + 1) * p)
    terms = F.when(k > 0, F.least(kd, F.ceil(40 / -F.log(r)).cast("double"))).otherwise(0.0).cast("long")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    down = F.aggregate(F.sequence(k.cast("long"), k.cast("long") - terms, F.lit(-1).cast("long")), start, lambda a, i: F.struct((a["term"] * i / (nd - i + 1) * ((1 - p) / p)).alias("term"), (a["sum"] + a["term"]).alias("sum")))
    near = (kd > 100_000) & (nd * p - kd < F.sqrt(nd * p * (1 - p)))
    return F.when((k >= n) | (kd >= nd * p) | near, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(last) * (down["sum"] + down["term"] / (1 - r))))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_steps() -> Column:
    """An array of (step, rule): the first step of the chain at which each rule rejects a document; STEPS if it never does."""
    out = []
    for i, (r, v) in enumerate(rule_values().items()):
        over = sum(((v > c).cast("int") for c in RULES[r]), F.lit(0))
        out.append(F.struct(F.when(over > 0, (len(RULES[r]) - over) * len(RULES) + i).otherwise(STEPS).alias("step"), F.lit(r).alias("rule")))
    return F.array(*out)


def cutoffs(last: int) -> dict[str, float]:
    """The cutoff of each rule after the chain's steps up to last; rules without one are left out."""
    n = len(RULES)
    return {r: sorted(cs, reverse=True)[(last - i) // n] for i, (r, cs) in enumerate(RULES.items()) if last >= i}


def thresholds(measured: DataFrame, labels: DataFrame, max_false: float = 0.05, significance: float = 0.05, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(stratum, last, n_good, n_rejected): the last step admitted in each stratum that has labelled good documents (-1: none), how many these are, and how many of them its cutoffs reject.

    All labelled good documents count that the base rules leave; null labels and ids are none, repeated labels count once, and repeated rows of documents each.
    """
    good = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("id")).distinct()
    held = measured.filter(~base_failed()).join(good, "id", "left_semi")
    hist = held.groupBy("stratum", F.array_min(rule_steps())["step"].alias("step")).agg(F.count("*").alias("n"))
    # A row for each stratum and step that rejects something new: at most STEPS + 1 for each stratum.
    own = W.partitionBy("stratum")
    hist = hist.withColumns({"n_good": F.sum("n").over(own), "rejected": F.sum("n").over(own.orderBy("step"))})
    level = F.lit(significance) / F.col("strata")
    strata = hist.agg(F.count_distinct(F.struct("stratum")).alias("strata"))
    hist = hist.crossJoin(F.broadcast(strata))  # one row
    fails = (F.col("step") < STEPS) & (binomial_tail(F.col("rejected"), F.col("n_good"), max_false) > level)
    out = hist.groupBy("stratum", "n_good", "strata").agg(F.min(F.when(fails, F.col("step"))).alias("stop"), F.collect_list(F.struct("step", "n")).alias("steps"))
    any_ = F.pow(F.lit(1 - max_false), F.col("n_good")) <= level  # the tail of no rejection at all
    out = out.withColumn("last", F.when(any_, F.coalesce("stop", F.lit(STEPS)) - 1).otherwise(-1))
    rejected = F.aggregate(F.filter("steps", lambda x: x["step"] <= F.col("last")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return out.select("stratum", "last", "n_good", rejected.alias("n_rejected"))


def judge(docs: DataFrame, labels: DataFrame, max_false: float = 0.05, significance: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, measures, base_failed, kept, failed_rules) of every row of docs, repeated rows too.

    A document is kept if it passes the base rules and exceeds no admitted cutoff of its stratum (null is a stratum of its own). A stratum with too few good labels for
    any step (90 at max_false = significance = 0.05 in five strata) has no cutoffs, as nothing could be guaranteed for it. A null text has no words and fails the base rules.
    Null ids have no labels. Other columns are ignored. A text is measured as a whole by one task, so it must fit there with its words.
    """
    measured = materialize(measures(docs, id_col, text_col, stratum_col), "measures")
    limits = thresholds(measured, labels, max_false, significance).select(F.col("stratum").alias("_stratum"), "last")
    out = measured.join(limits, F.col("stratum").eqNullSafe(F.col("_stratum")), "left").withColumn("last", F.coalesce("last", F.lit(-1)))
    failed = F.transform(F.filter(rule_steps(), lambda x: x["step"] <= F.col("last")), lambda x: x["rule"])
    out = out.withColumns({"base_failed": base_failed(), "failed_rules": failed})
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), F.array_join("failed_rules", ",").alias("failed_rules"),
    )
