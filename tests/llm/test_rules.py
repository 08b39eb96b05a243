"""Cutoffs of the quality rules on strata with many, few and no labels."""

import math
import random
import re
from collections import Counter

from tilewright.llm import rules


def _rows(lang, first, clean, junk):
    r = random.Random(first)
    words = ["".join(r.choice("abcde") for _ in range(6)) for _ in range(400)]
    text = lambda symbols: " ".join(r.sample(words, 40) + ["#" * 10] * symbols)
    return [(first + i, text(i >= clean), lang) for i in range(clean + junk)]


def _learnt(spark, rows, bad):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], int("#" not in r[1])) for r in rows if r[0] not in bad], "doc_id long, quality int")
    return docs, labels, {r["doc_id"]: r["kept"] for r in rules.quality_rules(docs, labels).collect()}


def test_junk_of_small_strata_goes(spark):
    rows = [x for i, lang in enumerate(("de", "en", "es", "fr")) for x in _rows(lang, 1000 * i, 90, 5)]
    rows += _rows("few", 9000, 40, 5)
    docs, labels, kept = _learnt(spark, rows, {3, 94})
    for doc_id, text, lang in rows:
        assert kept[doc_id] == ("#" not in text or lang == "few"), (doc_id, lang)
    assert {r["doc_id"] for r in rules.passing(docs, labels).collect()} == {x for x, k in kept.items() if k}


def test_steps_get_stricter_and_are_tested_together():
    for a, b in zip(rules.STEPS, rules.STEPS[1:], strict=False):
        assert all(b[x] <= a[x] for x in rules.RULES)
    assert rules.tested_strata({86: 4}, 0.05, 0.05) == 4 and rules.tested_strata({85: 4}, 0.05, 0.05) == 3
    assert rules.tested_strata({58: 1}, 0.05, 0.05) == 0 and rules.tested_strata({59: 1, 10: 1}, 0.05, 0.05) == 1
    for r in (random.Random(i) for i in range(200)):
        sizes = Counter(r.choice([20, 59, 60, 80, 86, 100, 120]) for _ in range(r.randint(1, 30)))
        ranked = sorted(sizes.elements(), reverse=True)
        told = max((i for i, n in enumerate(ranked, 1) if rules.at_most(0, n, 0.05) <= 0.05 / i), default=0)
        assert rules.tested_strata(sizes, 0.05, 0.05) == told
    # rules that reject 3 % each reject 6 % together
    assert rules.allowed_step({7: 30, 9: 30}, 1000, 0.05, 0.05) == 8


def test_first_step(spark):
    r = random.Random(2)
    rows = [tuple(r.randint(1, 40) for _ in rules.COUNTS) for _ in range(300)]
    c = {x: rules.F.col(x) for x in rules.COUNTS}
    found = spark.createDataFrame(rows, list(rules.COUNTS)).select(*rules.COUNTS, rules.first_step(c).alias("at")).collect()
    for x in found:
        told = [i for i, step in enumerate(rules.STEPS) if any(x[p] > x[w] * step[k] for k, (p, w) in rules.RULES.items())]
        assert x["at"] == (told[0] if told else None)
    assert math.isclose(rules.STEPS[-1]["upper"], rules.CUTOFFS[-1])


def test_more_strata_than_any_cap(spark):
    """Seventy languages with labels enough: each has cutoffs of its own, and its clean documents stay."""
    rows = [x for i in range(70) for x in _rows(f"l{i}", 1000 * i, 150, 2)]
    rows += [(10**6 + i, t, None) for i, (_, t, _) in enumerate(_rows("", 0, 150, 2))]
    docs, labels, kept = _learnt(spark, rows, set())
    assert all(kept[i] == ("#" not in text) for i, text, _ in rows)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    """What the rules count, by plain string work."""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines), "n_bangs": text.count("!"),
        "n_upper": len(re.findall("[A-Z]", text)), "n_echo": sum(a == b for a, b in zip(words, words[1:], strict=False)),
    }


def plain_verdict(rows, labels):
    """Kept or not, from plain counting and plain binomials."""
    good = {i for i in labels if labels[i] == 1}
    base, shares = {}, {}
    for i, text, _ in rows:
        c = plain_counts(text or "")
        base[i] = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
        shares[i] = {k: (c[p], c[w]) for k, (p, w) in rules.RULES.items()}
    hit = lambda i, step: any(p > w * step[k] for k, (p, w) in shares[i].items())
    by = {}
    for i, _, lang in rows:
        if i in good and not base[i]:
            by.setdefault(lang, []).append(i)
    tested = max((m for m in range(1, len(by) + 1) if sum(0.95 ** len(x) <= 0.05 / m for x in by.values()) >= m), default=0)
    allowed = {}
    for lang, ids in by.items():
        for step in rules.STEPS:
            k, n = sum(hit(i, step) for i in ids), len(ids)
            if k >= n * 0.05 or sum(math.comb(n, j) * 0.05**j * 0.95 ** (n - j) for j in range(k + 1)) > 0.05 / max(1, tested):
                break
            allowed[lang] = step
    return {i: not base[i] and not (lang in allowed and hit(i, allowed[lang])) for i, _, lang in rows}


def test_verdict_equals_plain_counting(spark):
    table = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    docs, labels = table("documents"), table("labels")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    told = plain_verdict(rows, {r["doc_id"]: r["quality"] for r in labels.collect()})
    found = {r["doc_id"]: r["kept"] for r in rules.quality_rules(docs, labels).collect()}
    assert found == told and 0 < sum(told.values()) < len(told)


def test_few_unseen_good_documents_are_rejected(spark):
    """Cutoffs of one half of the labelled documents reject no more than the risk (with its sampling error) of the other half's good ones."""
    table = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    docs, labels = table("documents"), table("labels")
    half = rules.F.pmod(rules.F.xxhash64("doc_id"), rules.F.lit(2)) == 0
    found = rules.quality_rules(docs, labels.where(half)).where("not base_failed").join(labels.where(~half & (rules.F.col("quality") == 1)), "doc_id")
    n, lost = found.count(), found.where("not kept").count()
    assert n > 1000 and lost <= n * rules.RISK + 3 * math.sqrt(n * rules.RISK)


def test_other_columns_and_odd_rows(spark):
    rows = _rows("en", 0, 150, 5) + [(None, "#" * 50 + " a" * 20, "en"), (7, None, None), (7, "", "en")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, _c long")
    docs = docs.withColumns({c: rules.F.col("_c") for c in ("_stratum", "_of", "_allowed", "kept", "n_words", "_doc", "_good", "q")})
    labels = spark.createDataFrame([(i, 1, "x") for i in range(150)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, quality int, _id string")
    found = rules.passing(docs.unionAll(docs), labels)
    assert found.columns == docs.columns
    assert Counter(r["_c"] for r in found.collect()) == Counter({i: 2 for i in range(150)})
    assert all(r[c] == r["_c"] for r in found.collect() for c in ("_stratum", "kept", "n_words", "q"))
