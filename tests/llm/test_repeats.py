"""Periodic runs against all periods tried one by one, on small alphabets, planted loops and odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tilewright.llm import queries, repeats
from tilewright.llm.repeats import find_runs

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_runs(w, least=24, times=3):
    """Every stretch of equal words q apart; it counts if no smaller q holds for it."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            found = w[i : j + q]
            if j > i and len(found) >= max(least, times * q):
                if not any(found[r:] == found[:-r] for r in range(1, q)):
                    out.append((i, len(found), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, planted=True):
    w = WORD.findall((text or "").encode())
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if planted and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())


def _looped(r, n, k):
    w = [b"%d" % r.randint(1, k) for _ in range(n)]
    if n and r.random() < 0.6:
        a = r.randrange(n)
        p = 1 + (n - a) // r.randint(3, 10)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


@pytest.mark.parametrize("least, times", [(24, 3), (4, 2), (6, 2), (3, 3), (2, 2)])
def test_runs_of_random_texts(least, times):
    r = random.Random(least)
    for _ in range(60):
        texts = [_looped(r, r.randint(0, 90), r.choice([1, 2, 2, 3, 4, 30])) for _ in range(r.randint(1, 8))]
        assert find_runs(texts, least, times) == [plain_runs(w, least, times) for w in texts]


def test_fibonacci_words_have_nested_runs():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 400:
        a, b = b, b + a
    assert find_runs([b], 2, 2) == [plain_runs(b, 2, 2)]


def test_long_and_single_runs():
    assert find_runs([[b"x"] * 3000, [], [b"y"]]) == [[(0, 3000, 1)], [], []]
    block = [b"%d" % i for i in range(1000)]
    assert find_runs([block * 3]) == [[(0, 3000, 1000)]]
    assert find_runs([block * 3 + block[:999]]) == [[(0, 3999, 1000)]]
    assert find_runs([block * 2 + block[:999]]) == [[]]  # one word short of three periods


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    found = queries.QUERIES["op11_periodic_runs"](spark, SF_DIR).collect()
    assert sorted(map(tuple, found)) == sorted(plain_row(d["doc_id"], d["text"]) for d in docs)
    assert sum(r["n_runs"] > 0 for r in found) > 5


def test_odd_rows(spark):
    loop = "one two three " * 20
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, loop), (4, loop), (4, loop), (5, "é\xa0x " * 30), (6, "word " * 2_000), (7, "a b " * 11 + "a")]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, n_runs string, _text int")
    found = sorted(map(tuple, repeats.periodic_runs(docs.drop("_text")).collect()), key=repr)
    assert found == sorted((plain_row(*r, planted=False) for r in rows), key=repr)
    planted = repeats.periodic_runs(docs, repeats.looped(F.col("doc_id"), F.col("text")))
    assert sorted(map(tuple, planted.collect()), key=repr) == sorted((plain_row(*r) for r in rows), key=repr)
    assert repeats.periodic_runs(docs.limit(0)).columns == planted.columns
    assert repeats.periodic_runs(docs.limit(0)).count() == 0
