"""Near duplicates against all links, and the pipeline's stage on repeated rows, repeated ids and null ids."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tilewright.llm import components, minhash


def test_one_row_of_each_group_stays(spark):
    r = random.Random(6)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    repeated, copied, other, nulls, late, lone = (text() for _ in range(6))
    rows = [
        (7, repeated), (7, repeated), (7, repeated),
        (9, copied), (1, copied), (9, other),  # the other text of id 9 is no copy
        (None, nulls), (None, nulls), (None, late), (30, late), (20, late),
        (None, lone), (None, None), (None, None), (40, ""),
    ]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long").repartition(3)
    found = corpus_pipeline.dedup(spark, docs, "")
    assert found.columns == docs.columns
    told = [(7, repeated), (1, copied), (9, other), (None, nulls), (20, late), (None, lone), (None, None), (None, None), (40, "")]
    assert Counter((x["doc_id"], x["text"]) for x in found.collect()) == Counter(told)


def _all_links(rows, k, percent):
    """Each id's set size and component, from every pair of sets that share a shingle."""
    sets, post, up = {}, defaultdict(list), {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        up[i] = i

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    same = {}
    for i in sorted(sets):
        first = same.setdefault(sets[i], i) if sets[i] else i
        up[i] = first
        if first == i:
            shared = Counter(j for x in sets[i] for j in post[x])
            for j, n in shared.items():
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n) and top(i) != top(j):
                    a, b = top(i), top(j)
                    up[max(a, b)] = min(a, b)
            for x in sets[i]:
                post[x].append(i)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("most_tests", [minhash.MOST_TESTS, 0])
def test_recall_on_the_small_table(spark, most_tests):
    """All of sf0.01, with buckets tested pair by pair and with all of them joined by rare shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = _all_links([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 4, 80)
    found = minhash.near_duplicates(docs, k=4, most_tests=most_tests).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == told


def test_copies_of_a_template(spark):
    """Texts that share most of their words, but too few to link, beside some that do link, all buckets joined by rare shingles."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    template = [word() for _ in range(150)]
    rows = [(i, " ".join(template[: r.randint(110, 150)] + [word() for _ in range(r.randint(12, 40))])) for i in range(250)]
    rows += [(1000 + i, rows[i][1] + " " + word()) for i in range(0, 60, 7)] + [(2000 + i, " ".join(template[:150] + [word()])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = minhash.near_duplicates(docs, k=4, most_tests=0).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found} == _all_links(rows, 4, 80)


def test_hashes_that_collide(spark, monkeypatch):
    """With 32-bit hashes that collide often, as those of very large sets do, no link is lost or made up."""
    whole = minhash.shingle_sets

    def crowded(texts, k):  # high halves of 9 bits
        few = lambda s: np.unique((s & np.uint64(0xFFFFFFFF)) | ((s >> np.uint64(55)) << np.uint64(32)))
        return [few(s) for s in whole(texts, k)]

    monkeypatch.setattr(minhash, "shingle_sets", crowded)
    r = random.Random(5)
    words = [str(r.random()) for _ in range(120)]
    texts = [" ".join(words[:100])] + [" ".join(words[: 100 - cut] + [str(r.random()) for _ in range(cut + add)]) for cut in range(30) for add in (0, 5)]
    batch = minhash.pa.RecordBatch.from_pydict({"_id": list(range(len(texts))), "_text": texts})
    (held,) = minhash._sets(4, False)(iter([batch]))
    sets = crowded(texts, 4)
    narrow = [set(np.asarray(x.values).tolist()) for x in held.column("members")]
    for i, s in enumerate(sets):
        lost = held.column("lost")[i].as_py()
        assert lost == len(s) - len(narrow[i])
        both = len(np.intersect1d(sets[0], s))
        assert both <= len(narrow[0] & narrow[i]) + min(lost, held.column("lost")[0].as_py())


def test_hot_stars(spark, monkeypatch):
    monkeypatch.setattr(components, "MANY_EDGES", 10)
    r = random.Random(3)
    edges = [(0, i) for i in range(1, 400)] + [(500 + i, 501 + i) for i in range(40)] + [(r.randint(600, 640), r.randint(600, 640)) for _ in range(30)] + [(None, 1), (7, 7)]
    found = {x["node"]: x["comp"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((up.setdefault(a, {a}), up.setdefault(b, {b})), key=len)
            if x is not y:
                y |= x
                up.update(dict.fromkeys(x, y))
    assert found == {n: min(s) for n, s in up.items()}


def test_repeated_rows_have_one_set_in_a_task():
    batch = minhash.pa.RecordBatch.from_pydict({"_id": [1, 1, 2, 1, None, None], "_text": ["a b", "a b", "a b", "c", "a b", "a b"]})
    (out,) = minhash._sets(4, True)(iter([batch]))
    assert out.column("_id").to_pylist() == [1, 2, 1, None]
