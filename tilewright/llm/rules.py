"""Quality rules whose cutoffs control the risk of rejecting good documents.

Each rule rejects a document when one share of it (symbols, repeated lines, ...) is above a cutoff.
``STEPS`` orders joint settings of all rules from mild to strict. For a stratum of documents, a step is
allowed when the labelled good documents there show, by the exact binomial test, that its rules together
reject more than ``risk`` of good documents with a chance below ``level / strata``. Steps are tried from
the mildest on and the first that is not allowed ends the sequence (fixed-sequence testing, which needs
no more correction); strata are corrected for by Bonferroni's inequality, and only those with enough
labels to allow a step at all are tested. So with a probability of at least 1 - level all strata keep at
least 1 - risk of their good documents that pass the base rules. Every value is a stratum of its own,
however many there are, and so is null; one without labels enough has the base rules only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_small
from .minhash import hashed_words, window_hashes

RISK, LEVEL = 0.05, 0.05
CUTOFFS = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)
#: Rule to the counts that it divides.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "same_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "bangs": ("n_bangs", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "echo": ("n_echo", "n_words"),
}
#: Which rules go from which cutoff to which, one after the other: all of them down to shares that no clean
#: prose has, then the ones of which clean prose has next to none, then those of which it has some.
_ORDER = (
    (tuple(RULES), 0.9, 0.3),
    (("symbols", "bangs", "echo"), 0.25, 0.05),
    (("symbols", "bangs"), 0.04, 0.02),
    (("same_lines", "repeats", "upper", "echo"), 0.25, 0.02),
)


def _steps() -> list[dict[str, float]]:
    out: list[dict[str, float]] = []
    for names, first, last in _ORDER:
        for cutoff in CUTOFFS[CUTOFFS.index(first) : CUTOFFS.index(last) + 1]:
            held = out[-1] if out else {}
            out.append(held | {rule: min(cutoff, held.get(rule, 1.0)) for rule in names})
    return out


#: Rule to cutoff, from mild to strict.
STEPS = _steps()

_SPACES = np.array([9, 10, 11, 12, 13, 32])
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_UPPER = np.arange(ord("A"), ord("Z") + 1)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_upper", "n_echo")


def repeated_words(words: list[bytes], k: int = 5) -> int:
    """Words that lie in a k-word window found twice or more in the text."""
    if len(words) <= k or len(set(words)) == len(words):
        return 0
    run = window_hashes(hashed_words([words]), k)
    order = np.argsort(run, kind="stable")
    same = run[order[1:]] == run[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(run), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for j in range(k):
        covered[j : j + len(run)] |= twice
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text; a null text has no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return (
        len(words),
        len(raw) - int(of[128:192].sum() + of[_SPACES].sum()),
        int(of[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        int(of[ord("!")]),
        int(of[_UPPER].sum()),
        sum(map(eq, words, words[1:])),
    )


def _count_frame(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_counts(t) for t in s], columns=list(COUNTS), dtype="int64")


def counts_of(text: Column) -> Column:
    """A struct of COUNTS."""
    return F.pandas_udf(_count_frame, ", ".join(f"{c} long" for c in COUNTS))(text)


def base_failed(c: dict[str, Column]) -> Column:
    return (c["n_words"] < 10) | (c["n_repeat_words"] * 100 > c["n_words"] * 20)


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), summed from its largest term down; 1 if k is not below the mean."""
    if k >= n * p:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term = total = math.exp(log)
    while k > 0 and term > total * 1e-17:
        term *= k * (1 - p) / ((n - k + 1) * p)
        k -= 1
        total += term
    return min(1.0, total)


def allowed_cutoff(rejected: list[int], n: int, risk: float, level: float, sequence: Sequence[float] = CUTOFFS) -> float | None:
    """The last item of the sequence that the test allows; None if not even the mildest is."""
    found = None
    for item, k in zip(sequence, rejected, strict=True):
        if at_most(k, n, risk) > level:
            break
        found = item
    return found


def tested_strata(labelled: dict[int, int], risk: float, level: float) -> int:
    """How many strata to correct for: the most for which so many have labels enough to allow a step.

    ``labelled`` has the number of strata by their number of labels. The answer depends on these numbers
    only, not on what the labels show. With a number of labels n, i strata can be tested together if
    (1 - risk) ** n <= level / i; so at any count only the richest strata that it allows are taken.
    """
    most = above = 0
    for n in sorted(labelled, reverse=True):
        above += labelled[n]
        most = max(most, min(above, int(level / at_most(0, n, risk) * (1 + 1e-12))))
    return most


def first_step(c: dict[str, Column]) -> Column:
    """The number of the mildest step that rejects the document; null if not even the strictest does."""
    found = []
    for rule, (part, whole) in RULES.items():
        at, last = None, None
        for i, step in enumerate(STEPS):
            if step[rule] != last:
                last = step[rule]
                above = c[part] > c[whole] * F.lit(last)
                at = F.when(above, i) if at is None else at.when(above, i)
        found.append(at)
    return F.least(*found)


#: Labels of a stratum beyond this number are told apart no more when strata are counted: so many would do for 10 ** 20 strata.
_ENOUGH = 1_000


def learn_steps(
    counted: DataFrame, labels: DataFrame, id_col: str, stratum_col: str, risk: float = RISK, level: float = LEVEL
) -> DataFrame:
    """(_of, _allowed): each stratum with labels and the number of its last allowed step, if any is.

    Learnt from all labelled good documents that pass the base rules. A document with a bad label, or
    repeated labels that differ, is no good document. The driver gets at most _ENOUGH counts of strata.
    """
    good = labels.groupBy(F.col(id_col).alias("_good")).agg(F.min("quality").alias("q")).where("q = 1")
    c = {name: F.col(name) for name in COUNTS}
    rows = counted.where(~base_failed(c)).join(good, F.col(id_col) == F.col("_good"))
    by_step = [F.count(F.when(F.col("_step") == i, 1)) for i in range(len(STEPS))]
    rows = rows.select(F.col(stratum_col).alias("_of"), first_step(c).alias("_step"))
    strata = cut(rows.groupBy("_of").agg(F.count(F.lit(1)).alias("_n"), F.array(*by_step).alias("_by_step")))
    sizes = strata.groupBy(F.least("_n", F.lit(_ENOUGH)).alias("n")).agg(F.count(F.lit(1)).alias("strata")).collect()
    each = level / max(1, tested_strata({r["n"]: r["strata"] for r in sizes}, risk, level))

    def allowed(totals: pd.Series, counts: pd.Series) -> pd.Series:
        found = [allowed_step(dict(enumerate(x)), n, risk, each) for n, x in zip(totals, counts, strict=True)]
        return pd.Series(found, dtype="Int32")

    return strata.select("_of", F.pandas_udf(allowed, "int")("_n", "_by_step").alias("_allowed"))


def allowed_step(by_step: dict[int, int], total: int, risk: float, level: float) -> int | None:
    """The last allowed step of a stratum with ``total`` good documents, of which ``by_step`` are first rejected by each."""
    rejected = list(accumulate(int(by_step.get(i, 0)) for i in range(len(STEPS))))
    return allowed_cutoff(rejected, int(total), risk, level, range(len(STEPS)))


def _judged(counted: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Adds ``kept`` to rows with COUNTS and _stratum: false if the base rules or the stratum's allowed step reject them."""
    steps = cut(learn_steps(counted, labels, id_col, "_stratum"))
    c = {name: F.col(name) for name in COUNTS}
    rows = join_small(counted, steps, F.col("_stratum").eqNullSafe(F.col("_of")), "left")
    return rows.withColumn("kept", ~base_failed(c) & ~F.coalesce(first_step(c) <= F.col("_allowed"), F.lit(False)))


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang"
) -> DataFrame:
    """One row per document: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Repeated rows each get a row. Null and empty texts have no words and fail the base rules; a null id
    has no label. Without enough labels in a stratum no step is allowed there and only the base rules
    reject; so it is with an empty table of labels. A share that equals a cutoff passes. A text is counted
    whole in one task (about 20 bytes of memory for each of its own). Other columns are not looked at.
    """
    counted = docs.select(
        F.col(id_col).alias("_id"), F.col(stratum_col).alias("_stratum"), counts_of(F.col(text_col)).alias("_c")
    )
    counted = cut(counted.select("_id", "_stratum", "_c.*"))
    c = {name: F.col(name) for name in COUNTS}
    return _judged(counted, labels.select(F.col(id_col).alias("_id"), "quality"), "_id").select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed(c).alias("base_failed"), "kept", "n_bangs", "n_upper", "n_echo",
    )


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The documents that the rules keep, with all their columns, whatever their names.

    The rows are written once with their counts beside them, so that each text is counted once.
    """
    counted = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(id_col).alias("_id"),
        F.col(stratum_col).alias("_stratum"), counts_of(F.col(text_col)).alias("_c"),
    )
    counted = cut(counted.select("_doc", "_id", "_stratum", "_c.*"))
    return _judged(counted, labels.select(F.col(id_col).alias("_id"), "quality"), "_id").where("kept").select("_doc.*")
