"""Quality of labels: accuracy, per-class figures, confusion, the release gate, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_class(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, correct, total) for each true class."""
    hit = F.count_if(F.col(truth).eqNullSafe(F.col(pred)))
    return rows.groupBy(truth).agg(hit.alias("correct"), F.count(F.lit(1)).alias("total"))


def class_report(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """(label, support, predicted, hits) of every class that is true or predicted somewhere."""
    t = rows.groupBy(F.col(truth).alias("label")).agg(
        F.count(F.lit(1)).alias("support"), F.count_if(F.col(truth) == F.col(pred)).alias("hits")
    )
    p = rows.groupBy(F.col(pred).alias("label")).agg(F.count(F.lit(1)).alias("predicted"))
    out = t.join(p, "label", "full")
    return out.select("label", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("support", "predicted", "hits")])


def label_report(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """(label, precision, recall, f1, support): a row for each class, then accuracy, macro avg and weighted avg.

    A ratio over nothing is 0. Rows without a prediction lower the recall of their class. The averages are over the
    classes, so they read one row of each.
    """
    n = class_report(rows, truth, pred).where("label is not null")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    each = n.select(
        F.col("label").cast("string").alias("label"), ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"), ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
        "support", "hits",
    )
    figures = ("precision", "recall", "f1")
    weighted = [ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in figures]
    macro = each.agg(*[F.avg(c).alias(c) for c in figures], F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), "*")
    by_size = each.agg(*weighted, F.sum("support").alias("support")).select(F.lit("weighted avg").alias("label"), "*")
    right = ratio(F.sum("hits"), F.sum("support"))
    accuracy = each.agg(right.alias("f1"), F.sum("support").alias("support")).select(
        F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"), "f1", "support"
    )
    return each.drop("hits").union(accuracy).union(macro).union(by_size)


def confusion(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    return rows.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))


def was_corrected(auto: Column, confirmed: Column) -> Column:
    """Nothing confirmed: no. Nothing read but something confirmed: yes. Else: whether they differ."""
    return confirmed.isNotNull() & ~auto.eqNullSafe(confirmed)


def ships(candidate: Column, incumbent: Column, tolerance: float = 0.005) -> Column:
    """The gate: the candidate may be worse by the tolerance at most."""
    return candidate - incumbent >= -tolerance


def worst_classes(incumbent: DataFrame, candidate: DataFrame, label: str, drop: float = 0.05) -> DataFrame:
    """(label, was, now) of the classes whose accuracy falls by more than ``drop``, the largest fall first.

    Both tables are those of ``per_class``; a class that one of them lacks counts as 0 there.
    """
    def share(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(label, (F.col("correct") / F.col("total")).alias(name))

    both = share(incumbent, "was").join(share(candidate, "now"), label, "full").na.fill(0.0, ["was", "now"])
    return both.where(F.col("now") < F.col("was") - drop).orderBy(F.desc(F.col("was") - F.col("now")), label)


def group_errors(rows: DataFrame, keys: list[str], truth: str, pred: str, lacking: int = 999) -> DataFrame:
    """(keys, ok, bad, error): right and wrong rows, and the mean distance of the wrong ones; nothing read is ``lacking`` off."""
    wrong = ~F.col(truth).eqNullSafe(F.col(pred))
    off = F.when(wrong, F.coalesce(F.abs(F.col(truth) - F.col(pred)), F.lit(lacking)))
    return rows.groupBy(*keys).agg(F.count_if(~wrong).alias("ok"), F.count_if(wrong).alias("bad"), F.avg(off).alias("error"))


def proven(rows: DataFrame, epoch: str, least: int) -> DataFrame:
    """The rows whose origin is known and not older than ``least``."""
    return rows.where(F.col(epoch) >= least)


def split_of(sheet: Column, first: int = 1, last: int = 65) -> Column:
    """``train`` for the sheets of a range, ``valid`` for all others and where the sheet is unknown."""
    return F.when(sheet.between(first, last), "train").otherwise("valid")


def class_of(number: Column, most: int = 75) -> Column:
    """A number's place among 1 to ``most`` sorted as texts; null for another number."""
    order = sorted(map(str, range(1, most + 1)))
    return F.try_element_at(F.create_map(*[F.lit(x) for i, n in enumerate(order) for x in (int(n), i)]), number.cast("int"))


def digit_reading(left: Column, right: Column, conf_left: Column, conf_right: Column) -> Column:
    """(value, conf) of two digits read apart: the number they make, and the mean of their confidences."""
    return F.struct((left * 10 + right).alias("value"), ((conf_left + conf_right) / 2).alias("conf"))


def mean_confidence(confs: Column, words: Column) -> Column:
    """The mean of the confidences of words that are not blank, negative ones left out; 0 if there are none."""
    both = F.filter(F.arrays_zip(confs.alias("c"), words.alias("w")), lambda x: (F.trim(x["w"]) != "") & (x["c"] >= 0))
    total = F.aggregate(both, F.lit(0.0), lambda s, x: s + x["c"].cast("double"))
    return F.coalesce(F.try_divide(total, F.size(both)), F.lit(0.0))


def merged(held: DataFrame, fresh: DataFrame, keys: list[str], corrected: Column, copies: int = 4) -> DataFrame:
    """Held rows and fresh ones, with copy: fresh rows replace held ones of their keys, and corrected ones count ``copies`` times."""
    stay = held.join(fresh.select(*keys), keys, "left_anti").select(*held.columns, F.lit(1).alias("copy"))
    return stay.unionByName(fresh.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(corrected, copies).otherwise(1)))))


def sliced_errors(rows: DataFrame, keys: list[str], truth: str, pred: str, apart: Column) -> DataFrame:
    """(keys, ok, bad, cut_ok, cut_bad): right and wrong rows, those for which ``apart`` holds counted on their own."""
    wrong, cut = ~F.col(truth).eqNullSafe(F.col(pred)), F.coalesce(apart, F.lit(False))
    count = lambda c: F.count_if(c)
    return rows.groupBy(*keys).agg(
        count(~cut & ~wrong).alias("ok"), count(~cut & wrong).alias("bad"), count(cut & ~wrong).alias("cut_ok"), count(cut & wrong).alias("cut_bad")
    )
