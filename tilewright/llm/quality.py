"""Quality classifier: Bradley-Terry ranking of documents by features of their whole texts.

P(a is better than b) = 1 / (1 + exp(-(s(a) - s(b)))), with s linear in the features. The weights come
from preference pairs (a labelled good, b labelled bad) by logistic loss on feature differences. The
threshold is the quantile of the labelled documents' scores at the share of bad ones among them.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

#: Labelled documents to learn from: the first so many in the order of their ids' hashes.
MOST_LABELLED = 20_000
PAIRS_EACH = 24
CUT = 0.3

_UPPER = np.arange(ord("A"), ord("Z") + 1)
_LOWER = np.arange(ord("a"), ord("z") + 1)
_DIGITS = np.arange(ord("0"), ord("9") + 1)
_SPACES = np.array([9, 10, 11, 12, 13, 32])
_SYMBOLS = np.frombuffer(b"#*$%&|<>@^~=_{}[]\\/", np.uint8)
_STOPS = np.frombuffer(b".?", np.uint8)

FEATURES = (
    "log_words", "symbols", "bars", "upper", "bangs", "digits", "word_length", "spread", "distinct", "top_word",
    "echo", "same_lines", "stops", "bare_words", "line_length",
)


def features(text: str | None) -> list[float]:
    """Features of a whole text, each bounded; null and empty texts have those of no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n, spaces = len(words), int(of[_SPACES].sum())
    chars = max(1, len(raw) - int(of[128:192].sum()) - spaces)
    letters = max(1, int(of[_UPPER].sum() + of[_LOWER].sum()))
    per = max(1, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    return [
        min(np.log1p(n), 12.0),
        min(of[_SYMBOLS].sum() / chars, 1.0),
        min(of[ord("|")] / per, 1.0),
        of[_UPPER].sum() / letters,
        min(of[ord("!")] / per, 2.0),
        of[_DIGITS].sum() / chars,
        min(lengths.mean(), 30.0),
        min(lengths.std(), 30.0),
        np.sqrt(len(counts) / per),
        np.sqrt(top / per),
        np.sqrt(sum(map(eq, words, words[1:])) / per),
        1 - len(set(lines)) / max(1, len(lines)),
        min(of[_STOPS].sum() / per, 1.0),
        sum(not w.isalpha() for w in words if w.isascii()) / per,
        min(np.log1p(n / max(1, len(lines))), 8.0),
    ]


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cutoff: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the threshold quantile of the ranking scores is at CUT."""
        at = (x - self.mean) / self.scale @ self.weights - self.cutoff + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(at, -500, 500)))


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs_each: int = PAIRS_EACH, ridge: float = 2.0) -> Ranker:
    """Learns the ranking. Every document of the rarer label meets ``pairs_each`` of the other, drawn with a fixed seed."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    better, worse = z[good], z[~good]
    draw, most = np.random.RandomState(7), max(len(better), len(worse))
    rounds = max(1, pairs_each * min(len(better), len(worse)) // most)
    a = np.concatenate([draw.permutation(most) for _ in range(rounds)]) % len(better)
    b = np.concatenate([draw.permutation(most) for _ in range(rounds)]) % len(worse)
    d = better[a] - worse[b]
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        slope = d.T @ p - ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    ranked, bad = np.sort((x - mean) / scale @ w), int((~good).sum())
    return Ranker(mean, scale, w, float(ranked[bad - 1] + ranked[bad]) / 2)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Ranker | None:
    """Fits the ranker on at most MOST_LABELLED labelled documents outside the held-out fifth.

    A document that is labelled both good and bad is bad. None without a good and a bad document. Of the
    texts of a repeated id the one with the least hash counts, so that reruns learn the same; ties in the
    order of ids' hashes go by id. Nothing but id, quality and text is looked at.
    """
    ids = (
        labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
        .where(crc_mod(F.col(id_col), 5) != 0)
        .groupBy(id_col).agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64(F.lit(1), id_col), id_col).limit(MOST_LABELLED)
        .select(F.col(id_col).cast("long").alias("_want"), "_quality")
    )
    make = F.pandas_udf(lambda s: pd.Series([features(t) for t in s]), "array<double>")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(
        F.broadcast(ids), F.col("_id") == F.col("_want")
    )  # the limit bounds what is broadcast
    by_hash = F.struct(F.xxhash64("_text").alias("h"), F.md5(F.col("_text").cast("binary")).alias("m"), F.col("x"))
    rows = rows.select("_id", "_quality", "_text", make("_text").alias("x"))
    found = rows.groupBy("_id").agg(F.first("_quality").alias("_quality"), F.min(by_hash).alias("_least")).orderBy("_id")
    found = found.select("_id", "_quality", "_least.x").collect()  # MOST_LABELLED rows at most
    good = np.array([r["_quality"] == 1 for r in found], bool)
    if good.all() or not good.any():
        return None
    return fit_pairs(np.array([r["x"] for r in found]), good)


def score_column(text: Column, ranker: Ranker | None) -> Column:
    """The score of each text; 0.5 where nothing could be learnt."""
    if ranker is None:
        return F.lit(0.5)

    def run(s: pd.Series) -> pd.Series:
        return pd.Series(ranker.score(np.array([features(t) for t in s]).reshape(-1, len(FEATURES))))

    return F.pandas_udf(run, "double")(text)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, held_out, score, predicted.

    Held out are ids whose crc32 (as text; null as the empty text) mod 5 is 0. Repeated rows each get a
    row, equal texts equal scores. Null and empty texts are scored by the features of no words. A score
    that equals CUT predicts 1. Without labels of both kinds (or with an empty table) every score is 0.5.
    A text's features are taken whole in one task, with its words in a list: about 60 bytes of memory for
    each word. Other columns are not looked at.
    """
    ranker = train(docs, labels, id_col, text_col)
    out = docs.select(
        F.col(id_col), (crc_mod(F.col(id_col), 5) == 0).alias("held_out"), score_column(F.col(text_col), ranker).alias("score")
    )
    return out.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))
