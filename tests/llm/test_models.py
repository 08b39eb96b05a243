"""Models and packing against plain versions; long texts, hot ids, and files that are not on a mounted disk."""

import itertools
import math
import random
import re
import resource
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import hmm, media, packing, quality, tokens


def _naive_best_fit(sizes, sources, clusters, capacity):
    """Longest first into the fullest bin that has room and holds neither the source nor the cluster; else a new one."""
    bins, out = [], [[] for _ in sizes]
    for i, size in enumerate(sizes):
        for j in range(size // capacity):
            out[i].append((j * capacity, capacity, len(bins)))
            bins.append((0, set(), set()))
    order = sorted((i for i, s in enumerate(sizes) if s % capacity), key=lambda i: (-(sizes[i] % capacity), i))
    for i in order:
        size = sizes[i] % capacity
        fits = [
            (left, b) for b, (left, ss, cs) in enumerate(bins)
            if left >= size and (sources[i] is None or sources[i] not in ss) and (clusters[i] is None or clusters[i] not in cs)
        ]
        b = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append((capacity, set(), set()))
        left, ss, cs = bins[b]
        bins[b] = (left - size, ss | {sources[i]}, cs | {clusters[i]})
        out[i].append((sizes[i] // capacity * capacity, size, b))
    return out


def test_packing_equals_naive_best_fit():
    r = random.Random(7)
    for _ in range(200):
        n = r.randint(0, 60)
        sizes = [r.choice([r.randint(1, 40), r.randint(1, 260), 100]) for _ in range(n)]
        sources = [r.choice([None, "a", "b", "c", "d"]) for _ in range(n)]
        clusters = [r.choice([None, *range(12)]) for _ in range(n)]
        assert packing.pack(sizes, sources, clusters, 100) == _naive_best_fit(sizes, sources, clusters, 100)


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 3))) for _ in range(60)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 3)))) for i in range(120)] + [(None, None), (5, "unseen zzzz"), (6, "unseen unseen")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_scores_are_sums_over_all_paths(spark, texts):
    """More words than have a class of their own, so that all kinds occur: with their own, in shared classes, and unknown."""
    many = [f"v{i:05d}" for i in range(hmm.OWN + 2000)]
    docs = texts.union(spark.createDataFrame([(1000, " ".join(many))] + [(2000 + i, " ".join(many[-i - 2 : -i])) for i in range(1, 9)], texts.schema))
    rows = docs.withColumnRenamed("doc_id", "_id").withColumnRenamed("text", "_text").withColumn("held_out", hmm.crc_mod(F.col("_id"), 5) == 1)
    assert not rows.where("_id = 1000").first()["held_out"]
    held = hmm.train(rows, 3, 2)
    counts = {bytes(r["word"]): r["c"] for r in held.words.collect()}
    assert held.own == sorted(counts, key=lambda w: (-counts[w], w))[: hmm.OWN]
    place = {w: 1 + i for i, w in enumerate(held.own)}
    found = {}
    for r in hmm.hmm_scores(docs, states=3).collect():
        found.setdefault((r["doc_id"], r["n_tokens"]), []).append(r["score"])
    kinds = set()
    for r in docs.where("doc_id is null or doc_id <> 1000").collect():
        words = (r["text"] or "").encode().split()
        classes = [place[w] if w in place else 1 + hmm.OWN + zlib.crc32(w[-3:]) % hmm.SHARED for w in words] + [0]
        kinds |= {(w in place, w in counts) for w in words}
        inside = [1.0 if w in place else (counts.get(w, 0) + 0.5) / (held.class_n[k] + 0.5 * (held.class_v[k] + 1)) for w, k in zip(words, classes, strict=False)]
        total = 0.0
        for path in itertools.product(range(3), repeat=len(classes)):
            p = held.model.start[path[0]] * held.model.emit[path[0], classes[0]]
            for a, b, k in zip(path, path[1:], classes[1:], strict=False):
                p *= held.model.move[a, b] * held.model.emit[b, k]
            total += p
        told = math.log10(total) + sum(map(math.log10, inside))
        assert any(abs(told - x) < 1e-6 for x in found[r["doc_id"], len(words) + 1])
    assert kinds == {(True, True), (False, True), (False, False)}


def test_most_frequent_words_are_exact(spark):
    """Many words of one count: those of their own are still the first by count, then by bytes."""
    rows = [(f"w{i:05d}".encode(), 5 + (i % 700 == 0)) for i in range(3000)]
    words = spark.createDataFrame([(bytearray(w), c) for w, c in rows], "word binary, c long").repartition(4)
    found = [bytes(r["word"]) for r in hmm._own_and_sent(words, 100, 50)]
    assert found[:100] == [w for w, _ in sorted(rows, key=lambda x: (-x[1], x[0]))[:100]] and len(found) == len(set(found))


def _plain_features(text):
    """The classifier's features, by plain string work."""
    text = text or ""
    words, n_spaces = re.findall(r"[^\x20\x09-\x0D]+", text), len(re.findall(r"[\x20\x09-\x0D]", text))
    n, chars = len(words), max(1, len(text) - n_spaces)
    per, letters = max(1, n), max(1, len(re.findall("[A-Za-z]", text)))
    lengths = [len(w.encode()) for w in words] or [0]
    mean = sum(lengths) / len(lengths)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    counts = Counter(words)
    return [
        min(math.log1p(n), 12), min(sum(c in "#*$%&|<>@^~=_{}[]\\/" for c in text) / chars, 1), min(text.count("|") / per, 1), len(re.findall("[A-Z]", text)) / letters,
        min(text.count("!") / per, 2), len(re.findall("[0-9]", text)) / chars, min(mean, 30), min(math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths)), 30),
        math.sqrt(len(counts) / per), math.sqrt(max(counts.values(), default=0) / per), math.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / per),
        1 - len(set(lines)) / max(1, len(lines)), min(len(re.findall("[.?]", text)) / per, 1), sum(bool(re.search("[^A-Za-z]", w)) for w in words if w.isascii()) / per,
        min(math.log1p(n / max(1, len(lines))), 8),
    ]


def plain_scores(rows, labels):
    """Id to score, by plain features and gradient ascent on the same drawn pairs."""
    texts = {r["doc_id"]: r["text"] for r in rows}
    known = {r["doc_id"]: r["quality"] for r in labels if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["doc_id"] in texts}
    ids = sorted(known)
    x, good = np.array([_plain_features(texts[i]) for i in ids]), np.array([known[i] == 1 for i in ids])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, draw, most = np.clip((x - mean) / scale, -8, 8), np.random.RandomState(7), max(good.sum(), (~good).sum())
    rounds = max(1, 24 * min(good.sum(), (~good).sum()) // most)
    a = np.concatenate([draw.permutation(most) for _ in range(rounds)]) % good.sum()
    b = np.concatenate([draw.permutation(most) for _ in range(rounds)]) % (~good).sum()
    d, w = z[good][a] - z[~good][b], np.zeros(x.shape[1])
    step = 1 / (np.linalg.norm(d, 2) ** 2 / 4 + 2)
    before = w
    for i in range(50_000):  # with momentum
        ahead = w + i / (i + 3) * (w - before)
        before, w = w, ahead + step * (d.T @ (1 / (1 + np.exp(d @ ahead))) - 2 * ahead)
        if i > 100 and np.abs(w - before).max() < 1e-12:
            break
    ranked, bad = np.sort((x - mean) / scale @ w), int((~good).sum())
    cut = (ranked[bad - 1] + ranked[bad]) / 2
    return {i: 1 / (1 + np.exp(-((np.array(_plain_features(t)) - mean) / scale @ w - cut + np.log(0.3 / 0.7)))) for i, t in texts.items()}


def test_scores_equal_plain_ones(spark):
    table = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    told = plain_scores(table("documents").collect(), table("labels").collect())
    for r in quality.quality_scores(table("documents"), table("labels")).collect():
        assert abs(r["score"] - told[r["doc_id"]]) < 1e-4 and r["predicted"] == (told[r["doc_id"]] >= 0.3)


def test_features_equal_plain_ones():
    for text in (None, "", " \n\t", "é ü! 12 a|b", "A a A\nA a A\n\n#!", "x" * 99 + " [y] <z> \\ / ~", "One. Two? three 4\x0bfive\x85six"):
        assert np.allclose(quality.features(text), _plain_features(text)), text


def test_ranker_equals_gradient_descent():
    r = np.random.RandomState(4)
    x = np.concatenate([r.randn(60, 4) + [1, 0, -0.5, 0], r.randn(40, 4)])
    good = np.arange(100) < 60
    found = quality.fit_pairs(x, good)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    draw = np.random.RandomState(7)  # the same pairs
    rounds = quality.PAIRS_EACH * 40 // 60
    a = np.concatenate([draw.permutation(60) for _ in range(rounds)]) % 60
    b = np.concatenate([draw.permutation(60) for _ in range(rounds)]) % 40
    d, w = z[:60][a] - z[60:][b], np.zeros(4)
    for _ in range(20_000):
        w += 1e-3 * (d.T @ (1 / (1 + np.exp(d @ w))) - 2.0 * w)
    assert np.allclose(found.weights, w, atol=1e-4)
    scores = found.score(x)
    assert (scores >= quality.CUT).sum() == 60  # the threshold is the quantile at the share of bad ones
    assert np.corrcoef(scores, good)[0, 1] > 0.3


def test_repeated_ids_teach_the_same_on_every_run(spark):
    r = random.Random(1)
    rows = [(i % 60, " ".join(r.choice(["good", "words", "#", "!"]) for _ in range(r.randint(5, 30)))) for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, None), (None, 1)], "doc_id long, quality int")
    models = [quality.train(spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels) for x, n in ((rows, 1), (rows[::-1], 7))]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].cutoff == models[1].cutoff


def test_long_payloads_are_stored_in_parts():
    r = np.random.RandomState(1)
    for n in (1, 7, 1000, 4000):
        payload = r.randint(0, 256, 576 * n, np.uint8).tobytes()
        assert media._long_fields(payload) == media._all_fields([payload])[0]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    text = "some words of a text, " * 1_000_000
    (out,) = media._digest(iter([media.pa.RecordBatch.from_pydict({"_id": [1], "_text": [text]})]))
    assert out.column("payload_bytes")[0].as_py() == -(-len(text) // 576) * 576
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000  # 22 MB of text once took 1.3 GB


def test_a_marker_far_away():
    data = np.zeros(5000, np.uint8)
    data[[10, 40, 41, 4000]] = 0xFF
    data[[11, 42, 4001]] = [0xD3, 0x00, 0xD9]
    assert media._next_marker(data, 0, step=64) == 4000 and media._next_marker(data[:3000], 0, step=64) == 3000


def test_files_that_are_not_mounted(spark, texts, tmp_path, monkeypatch):
    """Ranged reads give what memory maps give; a hot id lies in several parts; blocks of ids are bounded."""
    import public_tokenizers

    path, folder = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/t"
    hot = texts.union(spark.range(500).select(F.lit(7).cast("long"), F.concat(F.lit("hot words "), F.col("id"))))
    manifest = tokens.write_tokens(hot, folder, path, 0, 4)
    assert sum(p["docs"] for p in manifest["parts"]) == hot.count() and max(p["docs"] for p in manifest["parts"]) < 400
    told = sorted(map(tuple, tokens.read_digests(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] is not None for r in told] == sorted(r[0] is not None for r in told)  # the null id is first
    monkeypatch.setattr(tokens, "_local", lambda path: None)
    monkeypatch.setattr(tokens, "READ_IDS", 5)
    part = [{"stem": p["stem"], "base": p["base"]} for p in manifest["parts"]]
    batches = tokens._reader(folder, "<u2")(iter([tokens.pa.RecordBatch.from_pylist(part)]))
    assert sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=lambda r: r[1]) == told
    assert tokens.document_tokens(folder, 3, manifest).tolist()[-1] == 0
    assert tokens.parts_of(texts) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, tokenizer = tokens._Encoder(path, 0), Tokenizer.from_file(path)
    assert not encoder.by_words and tokens._Encoder(public_tokenizers.path("byte_bpe_50k.json"), 0).by_words
    for text in ("Some Words  here\nand there", "", None, "é ü!"):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == [*ids, 0]
