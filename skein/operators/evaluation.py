"""Scores of predictions, agreement of raters, and correlations."""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import draw
from skein.operators.sampling import interval, resample


def share(c):
    return F.avg(c.cast("double"))


def accuracy(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """One row (accuracy, n); rows with a null on either side are left out."""
    used = rows.where(F.col(gold).isNotNull() & F.col(pred).isNotNull())
    return used.agg(share(F.col(gold) == F.col(pred)).alias("accuracy"), F.count("*").alias("n"))


def per_label(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """(label, tp, fp, fn, f1) of each label of either side; F1 is 0 where it would divide by 0."""
    used = rows.where(F.col(gold).isNotNull() & F.col(pred).isNotNull())
    hit = F.col(gold) == F.col(pred)
    sides = F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(True).alias("is_gold")), F.struct(F.col(pred).alias("label"), F.lit(False).alias("is_gold"))))
    each = used.select(hit.alias("hit"), sides.alias("s")).groupBy("s.label").agg(
        F.count_if(F.col("hit") & F.col("s.is_gold")).alias("tp"), F.count_if(~F.col("hit") & ~F.col("s.is_gold")).alias("fp"), F.count_if(~F.col("hit") & F.col("s.is_gold")).alias("fn")
    )
    return each.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def binary_scores(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """One row (accuracy, precision, recall, f1, over_rate, n) of boolean columns; over_rate: predicted where gold is false."""
    used = rows.where(F.col(gold).isNotNull() & F.col(pred).isNotNull())
    g, p = F.col(gold), F.col(pred)
    sums = used.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return sums.select(
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("over_rate"), (tp + fp + fn + tn).alias("n")
    )


def kappa(rows: DataFrame, a: str, b: str, weighted: bool = True, by: list[str] | None = None) -> DataFrame:
    """(*by, kappa, n): Cohen's kappa of two ratings, with quadratic weights by the index of the sorted labels, or none.

    1 where no disagreement is expected. Ratings are counted first: what is paired are labels, not rows.
    """
    by = by or []
    used = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = used.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    if not by:
        cells, by = cells.withColumn("_all", F.lit(1)), ["_all"]
    labels = cells.select(*by, F.explode(F.array("a", "b")).alias("label")).distinct()
    labels = labels.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("label")))
    n = cells.groupBy(*by).agg(F.sum("o").alias("n"))
    rows_a = cells.groupBy(*by, F.col("a").alias("label")).agg(F.sum("o").alias("m")).join(labels, [*by, "label"]).select(*by, F.col("i").alias("ia"), F.col("m").alias("ma"))
    rows_b = cells.groupBy(*by, F.col("b").alias("label")).agg(F.sum("o").alias("m")).join(labels, [*by, "label"]).select(*by, F.col("i").alias("ib"), F.col("m").alias("mb"))
    weight = F.pow(F.col("ia") - F.col("ib"), 2) if weighted else (F.col("ia") != F.col("ib")).cast("double")
    expected = rows_a.join(rows_b, by).join(n, by).groupBy(*by).agg(F.sum(weight * F.col("ma") * F.col("mb") / F.col("n")).alias("e"))
    seen = cells.join(labels.select(*by, F.col("label").alias("a"), F.col("i").alias("ia")), [*by, "a"]).join(labels.select(*by, F.col("label").alias("b"), F.col("i").alias("ib")), [*by, "b"])
    observed = seen.groupBy(*by).agg(F.sum(weight * F.col("o")).alias("w"), F.sum("o").alias("n"))
    return observed.join(expected, by).select(*(c for c in by if c != "_all"), F.coalesce(1 - F.try_divide("w", "e"), F.lit(1.0)).alias("kappa"), "n")


def rater_pairs(ratings: DataFrame, item: str, rater: str, score: str) -> DataFrame:
    """(rater_a, rater_b, kappa, n) of each pair of raters over the items both rated, quadratic weights."""
    a = ratings.select(F.col(item).alias("item"), F.col(rater).alias("rater_a"), F.col(score).alias("a"))
    b = ratings.select(F.col(item).alias("item"), F.col(rater).alias("rater_b"), F.col(score).alias("b"))
    return kappa(a.join(b, "item").where("rater_a < rater_b"), "a", "b", by=["rater_a", "rater_b"])


def average_ranks(rows: DataFrame, c: str, buckets: int = 4096) -> DataFrame:
    """(value, rank): the mean rank of each distinct value, from counts.

    Running sums go over equal-width buckets of the values first, then within each bucket, so no task holds all values.
    """
    counts = rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    place = F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")) * buckets), F.lit(0))
    counts = counts.join(F.broadcast(span)).withColumn("bucket", place)
    sums = counts.groupBy("bucket").agg(F.sum("n").alias("in_bucket"))
    upto = F.sum("in_bucket").over(Window.orderBy("bucket"))  # one row per bucket
    sums = sums.select("bucket", (upto - F.col("in_bucket")).alias("ahead"))
    within = Window.partitionBy("bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("ahead") + F.coalesce(F.sum("n").over(within), F.lit(0))
    return counts.join(F.broadcast(sums), "bucket").select("value", (before + (F.col("n") + 1) / 2).alias("rank"))


def correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row (pearson, spearman, n) over rows with both values."""
    used = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rx, ry = (average_ranks(used, c).select(F.col("value").alias(c), F.col("rank").alias(f"r{c}")) for c in ("x", "y"))
    return used.join(rx, "x").join(ry, "y").agg(F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.count("*").alias("n"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation under Student's t with n - 2 degrees of freedom."""
    if n < 3 or abs(r) >= 1:
        return 1.0 if n < 3 else 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    a, b, x = (n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def rounded_vote(c):
    """The mean rating rounded half to even."""
    return F.bround(F.avg(c), 0).cast("int")


def alternative_annotator(ratings: DataFrame, judge: DataFrame, item: str = "item", rater: str = "rater", score: str = "score") -> DataFrame:
    """One row (judge_agreement, human_agreement, verdict, judge_kappa, human_kappa, n_items, n_raters): may a judge stand in
    for a human rater?

    Each human is compared with the rounded vote of the others, the judge with that of all; YES if the judge agrees at
    most 0.05 less often. The kappas, with quadratic weights, are those of the same comparisons, the humans' the mean over
    them. An item's ratings are few; the others' vote follows from the item's sum.
    """
    total = F.sum(score).over(Window.partitionBy(item))
    n = F.count("*").over(Window.partitionBy(item))
    others = F.bround((total - F.col(score)) / (n - 1), 0).cast("int")
    loo = ratings.withColumn("n", n).withColumn("others", F.when(n > 1, others)).where("others is not null")
    human = loo.groupBy(rater).agg(share(F.col(score) == F.col("others")).alias("a")).agg(F.avg("a").alias("human_agreement"))
    votes = ratings.groupBy(item).agg(rounded_vote(F.col(score)).alias("vote"))
    judged = judge.join(votes, item)
    agreed = judged.agg(share(F.col(score) == F.col("vote")).alias("judge_agreement"), F.count("*").alias("n_items"))
    kappas = kappa(judged, score, "vote").select(F.col("kappa").alias("judge_kappa"))
    folds = kappa(loo.select(F.col(rater).alias("fold"), F.col(score).alias("own"), "others"), "own", "others", by=["fold"])
    folds = folds.agg(F.avg("kappa").alias("human_kappa"), F.count("*").alias("n_raters"))
    verdict = F.when(F.col("judge_agreement") >= F.col("human_agreement") - 0.05, "YES").otherwise("NO")
    for one in (human, kappas, folds):  # one row each
        agreed = agreed.join(F.broadcast(one))
    return agreed.select("judge_agreement", "human_agreement", verdict.alias("verdict"), "judge_kappa", "human_kappa", "n_items", "n_raters")


def mean_rater_kappa(ratings: DataFrame, item: str, rater: str, score: str) -> DataFrame:
    """One row (kappa, pairs): the mean kappa over the pairs of raters, 1 if there are fewer than two raters."""
    return rater_pairs(ratings, item, rater, score).agg(F.coalesce(F.avg("kappa"), F.lit(1.0)).alias("kappa"), F.count("*").alias("pairs"))


def win_rate(ratings: DataFrame, item: str, rater: str, score: str, a: str, b: str) -> DataFrame:
    """One row (win_rate, n): how often rater or system ``a`` scores higher than ``b`` on the items both have."""
    one, two = (ratings.where(F.col(rater) == x).select(F.col(item).alias("item"), F.col(score).alias(side)) for x, side in ((a, "a"), (b, "b")))
    return one.join(two, "item").agg(share(F.col("a") > F.col("b")).alias("win_rate"), F.count("*").alias("n"))


def baselines(rows: DataFrame, key: str, gold: str, flag: Column, seed: int = 7) -> DataFrame:
    """The rows once per trivial system, with ``system``, ``pred`` and ``flagged``.

    ``random`` draws one of the gold labels by a hash of the key and flags every row; ``majority`` takes the most frequent
    label (ties to the first) and flags by ``flag``. The labels are a taxonomy's worth and go along as one array.
    """
    counts = rows.where(F.col(gold).isNotNull()).groupBy(F.col(gold).alias("label")).agg(F.count("*").alias("n"))
    listed = counts.agg(F.array_sort(F.collect_list("label")).alias("labels"), F.min_by("label", F.struct(-F.col("n"), "label")).alias("top"))
    both = rows.join(F.broadcast(listed))
    drawn = F.try_element_at("labels", (draw(seed, F.col(key)) % F.size("labels") + 1).cast("int"))
    systems = F.array(F.struct(F.lit("random").alias("system"), drawn.alias("pred"), F.lit(True).alias("flagged")), F.struct(F.lit("majority").alias("system"), F.col("top").alias("pred"), F.coalesce(flag, F.lit(False)).alias("flagged")))
    return both.withColumn("s", F.explode(systems)).select(*rows.columns, "s.*")


def record(rows: DataFrame, system: str, key: str, gold: str, pred: str, gold_flag: str, flag: str, resamples: int = 2_000) -> DataFrame:
    """One row per system: accuracy with its interval and macro F1 of the labels, and the scores of the flags.

    (system, n, accuracy, lower, upper, macro_f1, flag_accuracy, precision, recall, flag_f1, over_rate). The systems are few,
    so each is evaluated by the operators above.
    """
    out = None
    for name in [r[0] for r in rows.select(system).distinct().orderBy(system).collect()]:  # the systems compared: a handful
        own = rows.where(F.col(system) == name)
        hits = own.where(F.col(gold).isNotNull() & F.col(pred).isNotNull()).groupBy(key).agg(F.max((F.col(gold) == F.col(pred)).cast("double")).alias("hit"))
        parts = [
            accuracy(own, gold, pred).select("n", "accuracy"),
            interval(resample(hits, key, "hit", resamples), stat="stat"),
            per_label(own, gold, pred).agg(F.avg("f1").alias("macro_f1")),
            binary_scores(own, gold_flag, flag).select(F.col("accuracy").alias("flag_accuracy"), "precision", "recall", F.col("f1").alias("flag_f1"), "over_rate"),
        ]
        row = parts[0]
        for p in parts[1:]:
            row = row.join(F.broadcast(p))  # one row each
        row = row.select(F.lit(name).alias("system"), "*")
        out = row if out is None else out.unionByName(row)
    return out
