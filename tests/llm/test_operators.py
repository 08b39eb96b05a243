"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import html as html_lib
import math
import random
import re
import struct
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tilewright.llm import hmm, html, media, minhash, mixing, packing, pages, quality, queries, rules, shards, tokens
from tilewright.llm.common import n_words

sys.path.insert(0, str(Path(__file__).parent))
from test_models import plain_scores  # noqa: E402
from test_rules import plain_verdict  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts():
    r = random.Random(4)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(400)]
    make = lambda n: " ".join(r.choice(words) + r.choice(["", "", ".", "\n"]) for _ in range(n))
    base = make(120)
    near = base.split(" ")
    near[5] = "changed"
    out = [None, "", " \n\t", "one", "one two three", base, base, base.upper(), " ".join(near), make(30_000), "| # | # " * 40, "aaa " * 60]
    return out + [make(r.randint(4, 90)) for _ in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, ["b", "a", None][i % 3], 1, 2) for i, t in enumerate(_texts())]
    rows += [(5, _texts()[5], "en", "a", 1, 2), (None, _texts()[12], None, None, 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, keys long, comp long").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i not in (10, 11)), 0) for i in range(5, 40)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_its_sql(same, name):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_media(docs):
    found = media.text_media(docs).collect()
    assert len(found) == docs.count()
    texts = Counter()
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        texts[r["doc_id"], len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])] += 1
    assert texts == Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found)


def test_media_longer_than_a_frame():
    payload = np.random.RandomState(1).randint(0, 256, 576 * 2100, np.uint8).tobytes()
    (stored,) = media.encode_payloads([payload])
    frames = media.parse_frames(stored)
    media.decode_thumbnails(frames)
    assert len(frames) == 3 and b"".join(f.thumb.tobytes() for f in frames) == payload


def _colour_jpeg(luma, interval):
    """A 4:2:0 image of MCUs, written bit by bit: luminance blocks with AC values, flat colour blocks."""
    down, across = luma.shape
    dc, ac = media._codes(media._DC_BITS), media._codes(bytes([0, 2, 1] + [0] * 13))  # AC symbols 0, 1, 0xF0
    def number(v):
        n = abs(v).bit_length()
        return format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""
    code = lambda c: format(c[0], f"0{c[1]}b")
    scan, bits, before, mcu = b"", "", [0, 0, 0], 0
    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        out = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        bits = ""
        return out
    for y in range(0, down, 2):
        for x in range(0, across, 2):
            if mcu and mcu % interval == 0:
                scan += flush() + bytes([0xFF, 0xD0 + (mcu // interval - 1) % 8])
                before = [0, 0, 0]
            for part, v in [(0, luma[y, x]), (0, luma[y, x + 1]), (0, luma[y + 1, x]), (0, luma[y + 1, x + 1]), (1, 3), (2, -4)]:
                d = int(v) - before[part]
                before[part] = int(v)
                bits += code(dc[abs(d).bit_length()]) + number(d)
                if part == 0:
                    bits += code(ac[2]) + code(ac[1]) + "1"  # sixteen zeros, then the value 1
                bits += code(ac[0])
            mcu += 1
    scan += flush()
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    return (
        b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + bytes([4] + [1] * 63)) + seg(0xDD, struct.pack(">H", interval))
        + seg(0xC0, struct.pack(">BHHB", 8, 8 * down - 3, 8 * across - 5, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        + seg(0xC4, b"\0" + media._DC_BITS + bytes(range(12))) + seg(0xC4, b"\x10" + bytes([0, 2, 1] + [0] * 13) + bytes([0, 1, 0xF0]))
        + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    )


def test_colour_images(spark):
    luma = np.random.RandomState(2).randint(-200, 200, (6, 8))
    for interval in (3, 1000):
        data = _colour_jpeg(luma, interval)
        rows = spark.createDataFrame([(1, data), (2, None), (3, b"x"), (4, data[:-40]), (5, data.replace(b"\xff\xc0", b"\xff\xc2"))], "id long, data binary")
        found = {r["id"]: r for r in media.jpeg_media(rows, "id", "data").collect()}
        assert (found[1]["status"], found[1]["width"], found[1]["height"], found[1]["n_parts"]) == ("ok", 59, 45, 3)
        thumb = np.frombuffer(found[1]["thumb"], np.uint8).reshape(found[1]["thumb_height"], found[1]["thumb_width"])
        assert (thumb == np.clip((luma * 4 + 4) // 8 + 128, 0, 255)).all()
        assert [found[i]["status"] for i in (2, 3, 4, 5)] == ["no image", "no image", "corrupt", "not baseline"]


def test_rules(docs, labels):
    found = {(r["doc_id"], r["n_words"]): r for r in rules.quality_rules(docs, labels).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        w = WORD.findall(text)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines, twice = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                twice += line in lines
                lines.add(line)
        x = found[r["doc_id"], len(w)]
        assert (x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(covered))
        assert x["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (x["base_failed"] and x["kept"])


def test_exact_binomial_cutoffs():
    for n, k, p in [(50, 0, 0.05), (400, 3, 0.02), (1000, 30, 0.05), (10, 9, 0.5)]:
        told = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert rules.at_most(k, n, p) == pytest.approx(told if k < n * p else 1.0)
    assert rules.allowed_cutoff([0] * len(rules.CUTOFFS), 10, 0.01, 0.01) is None
    assert rules.allowed_cutoff([0] * 5 + [900] * (len(rules.CUTOFFS) - 5), 1000, 0.01, 0.01) == rules.CUTOFFS[4]


def test_forward_equals_all_paths():
    r = np.random.RandomState(3)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = hmm.Model(norm(r.rand(3)), norm(r.rand(3, 3)), norm(r.rand(3, 7)))
    seqs = [r.randint(0, 7, n).astype(np.uint16) for n in (1, 5, 2, 5)]
    logs, starts, moves, emits = hmm.forward(model, seqs, counts=True)
    import itertools

    s, m, e = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 7))
    for seq, log in zip(seqs, logs, strict=True):
        total, parts = 0.0, []
        for path in itertools.product(range(3), repeat=len(seq)):
            p = model.start[path[0]] * model.emit[path[0], seq[0]]
            for a, b, x in zip(path, path[1:], seq[1:], strict=False):
                p *= model.move[a, b] * model.emit[b, x]
            total += p
            parts.append((path, p))
        assert log == pytest.approx(np.log(total))
        for path, p in parts:
            s[path[0]] += p / total
            for a, b in zip(path, path[1:], strict=False):
                m[a, b] += p / total
            for a, x in zip(path, seq, strict=True):
                e[a, x] += p / total
    assert starts == pytest.approx(s) and moves == pytest.approx(m) and emits == pytest.approx(e)


def test_scores(docs):
    found = hmm.hmm_scores(docs)
    held = found.collect()
    rows = [(r["doc_id"], WORD.findall((r["text"] or "").translate({c: c + 32 for c in range(65, 91)}))) for r in docs.collect()]
    train = Counter()
    for i, w in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            train.update(w)
            train[None] += 1
    n, v = sum(train.values()), len(train)
    told = sorted((i is not None, i or 0, len(w) + 1, round(sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in [*w, None]), 6)) for i, w in rows)
    assert told == sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], round(r["base_score"], 6)) for r in held)
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in held)


def test_classes_by_sql_equal_those_by_python(spark):
    words = [b"a", b"ab", b"abc", "é".encode(), b"abcdef", "über".encode()]
    rows = spark.createDataFrame([(bytearray(w),) for w in words], "word binary").select("word", hmm._word_class(F.col("word")).alias("k"))
    assert all(r["k"] == hmm.shared_class(bytes(r["word"])) for r in rows.collect())


def test_mix_reaches_targets(docs):
    found = mixing.mix(docs).collect()
    by = {}
    for r in found:
        by.setdefault((r["source_size"], r["target"]), []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert sum(t for _, t in by) == pytest.approx(sum(r["size"] for r in found))
    for (_, target), rows in by.items():
        assert abs(sum(r["taken"] for r in rows) - target) <= max(r["size"] for r in rows) * 2
    assert mixing.mixed_documents(docs).columns == docs.columns


@pytest.mark.parametrize("k", [4, 5])
def test_dedup(docs, k):
    sets = {}
    for r in docs.collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    ids = [i for i in sets if i is not None]
    comp = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    for r in minhash.near_duplicates(docs, k=k).collect():
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == (comp[r["doc_id"]] if r["doc_id"] is not None else 12)
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_tokens(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, folder = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/t"
    manifest = tokens.write_tokens(docs, folder, path, 0, 3)
    found = sorted(tokens.read_digests(spark, folder).collect(), key=lambda r: r["start"])
    tokenizer, at = Tokenizer.from_file(path), 0
    told = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    for place, (x, r) in enumerate(zip(found, told, strict=True)):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        assert (x["doc_id"], x["start"], x["n_tokens"], x["ids_crc32"]) == (r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert tokens.document_tokens(folder, place).tolist() == ids
        at += len(ids)
    assert manifest["tokens"] == at


def test_packing(docs):
    items = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.lit(1).alias("cluster"))
    found = packing.best_fit(items, "doc_id", "size", "source", "cluster", capacity=50, shard_rows=10).collect()
    assert sum(r["piece_len"] for r in found) == sum(r["size"] for r in items.collect())
    small = [r for r in found if r["bin_id"] is not None]
    assert max(Counter(r["bin_id"] for r in small).values()) == 1  # one cluster: nothing shares a bin



def test_packing_keeps_whole_numbers_beside_nulls(spark):
    """Ids, sources and clusters above 2^53 stay as they are if others in the shard are null."""
    big = 2**60
    rows = [(big + 1, 300, big + 1, big + 5), (big + 3, 300, big + 3, big + 7), (None, 300, None, None), (big + 5, 300, big + 5, None), (big + 7, 300, None, big + 9), (big + 9, 0, None, None), (-big - 1, 100, big + 7, big + 11)]
    items = spark.createDataFrame(rows, "doc_id long, size long, source long, cluster long")
    found = packing.best_fit(items, "doc_id", "size", "source", "cluster").collect()
    assert sorted((r["doc_id"], r["piece_len"]) for r in found if r["doc_id"] is not None) == sorted((i, n) for i, n, _, _ in rows if i is not None)
    assert len({r["bin_id"] for r in found if r["piece_len"]}) == 1  # nothing conflicts
    same = spark.createDataFrame([(1, 300, None, big + 1), (2, 300, None, big + 2), (3, 300, None, None), (4, 300, None, big + 1)], "doc_id long, size long, source long, cluster long")
    bins = {r["doc_id"]: r["bin_id"] for r in packing.best_fit(same, "doc_id", "size", "source", "cluster").collect()}
    assert bins[1] != bins[4] and len(set(bins.values())) == 2


def test_best_fit_takes_the_tightest_compatible_bin():
    found = packing.pack([60, 70, 30, 25, 30], ["a", "b", "b", "c", None], [1, 2, 3, 4, 5], 100)
    assert [x[0][2] for x in found] == [1, 0, 1, 2, 0]
    assert packing.pack([250], ["a"], [1], 100) == [[(0, 100, 0), (100, 100, 1), (200, 50, 2)]]


def test_pages():
    maker, good, total = pages.PageMaker(99), 0, 0
    trees = html.trained()
    for _ in range(60):
        page = maker.page()
        nodes, texts = html.parse(page)
        told = html._joined(texts, np.array([True, *(x.marked for x in nodes[1:])])).split("\n")
        found = html.extract([page.replace(f" {pages.MARK}", "")], trees)[0].split("\n")
        both = sum((Counter(told) & Counter(found)).values())
        good, total = good + 2 * both, total + len(told) + len(found)
    assert good / total > 0.93
    assert html.extract([None, "", "<p", "a < b"], trees)[:2] == ["", ""]
    text = "<body><nav><a href=/>x y</a></nav><article><h1>A &amp;\n b</h1><p>One\t two&nbsp;<b>three</b></p><ul class='share'><li>z</li></ul></article>"
    assert html.extract([text], trees) == ["A & b\nOne two three"]
    assert html_lib.unescape("&amp;") == "&"


def test_shards(spark, docs, tmp_path):
    root = f"file://{tmp_path}/s"
    for i in range(5):
        assert shards.append(docs.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(5)) == i).coalesce(1), root) == i + 1
    assert shards.manifest(spark, root).agg(F.sum("files"), F.sum("rows"), F.count("path")).first()[:] == (5, docs.count(), 5)
    version = shards.compact(spark, root)
    assert version > 5 and shards.compact(spark, root) == version
    assert shards.manifest(spark, root).agg(F.sum("files")).first()[0] < shards.LEAST_RUN
    assert shards.live(spark, root, docs.schema).exceptAll(docs).count() == 0
    for v in (5, version):
        assert shards.live(spark, root, docs.schema, v).count() == docs.count()
    with pytest.raises(Exception, match="exist"):
        shards.commit(spark, root, shards.manifest(spark, root), version)
    gone = shards.manifest(spark, root, 5).join(shards.manifest(spark, root, version), "path", "left_anti").count()
    assert gone >= shards.LEAST_RUN and shards.expire(spark, root) == gone + version - 6
    assert shards.live(spark, root, docs.schema).count() == docs.count()


def test_compaction_goes_on_beyond_one_step(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "STEP_RUNS", 3)
    root = f"file://{tmp_path}/s"
    shards.append(docs, root, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(11)))
    shards.append(docs.limit(0), root)
    assert shards.manifest(spark, root).count() == 11
    shards.compact(spark, root)
    assert shards.manifest(spark, root).agg(F.sum("files"), F.sum("rows")).first()[1] == docs.count()
    assert shards.manifest(spark, root).agg(F.sum("files")).first()[0] < shards.LEAST_RUN
    assert shards.expire(spark, root, grace=3600) == 0  # what is young may be another writer's
    assert shards.expire(spark, root) > 0
    assert shards.live(spark, root, docs.schema).exceptAll(docs).count() == 0 and docs.exceptAll(shards.live(spark, root, docs.schema)).count() == 0


def test_ranker(spark, docs, labels):
    found = quality.quality_scores(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    table = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    rows = quality.quality_scores(table("documents"), table("labels")).join(table("labels"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


@pytest.mark.parametrize("name", queries.QUERIES)
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "labels", "pages", "conversations"):
        spark.read.parquet(f"{SF_DIR}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_pipeline(spark):
    """The registered form; that stages keep the columns of documents is tested in test_pipeline_rows."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    assert found and {r["doc_id"] for r in found} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert all(r["piece_len"] <= packing.CAPACITY for r in found)


def _near_duplicates(rows):
    """Ids and component of each, by all pairs of 5-word shingle sets."""
    sets = {}
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp, todo = {}, sorted(sets)
    for i in todo:
        if i in comp:
            continue
        comp[i], queue = i, [i]
        while queue:
            a = queue.pop()
            for b in todo:
                if b not in comp and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[b] = i
                    queue.append(b)
    return comp


def test_pipeline_stages(spark, tmp_path):
    import duckdb

    table = lambda t: spark.read.parquet(f"{SF_DIR}/{t}.parquet")
    docs, labels, lot = table("documents"), table("labels"), {}
    stages = dict(corpus_pipeline.STAGES)

    def after(name, rows):
        stages[name](spark, rows, SF_DIR).write.parquet(f"{tmp_path}/{name}")
        lot[name] = spark.read.parquet(f"{tmp_path}/{name}")
        return lot[name].collect()

    told = {i for i, score in plain_scores(docs.collect(), labels.collect()).items() if score >= 0.3}
    rows = after("quality_classifier", docs)
    assert {r["doc_id"] for r in rows} == told and len(rows) == len(told) < docs.count()

    found = after("quality_rules", lot["quality_classifier"])
    verdict = plain_verdict([(r["doc_id"], r["text"], r["lang"]) for r in rows], {r["doc_id"]: r["quality"] for r in labels.collect()})
    assert {r["doc_id"] for r in found} == {i for i, kept in verdict.items() if kept}

    kept = after("near_dedup", lot["quality_rules"])
    assert sorted(r["doc_id"] for r in kept) == sorted({*_near_duplicates(found).values()})

    con = duckdb.connect()
    con.register("documents", lot["near_dedup"].toArrow())
    taken = {i: (n, size) for i, size, n in con.sql(f"select doc_id, size, taken from ({mixing.MIX_SQL})").fetchall()}
    copies = Counter(r["doc_id"] for r in after("mix_sources", lot["near_dedup"]))
    assert copies == Counter({i: n // size for i, (n, size) in taken.items() if n})

    packed = Counter()
    for r in corpus_pipeline.run(spark, SF_DIR).collect():
        packed[r["doc_id"]] += r["piece_len"]
    assert packed == Counter({i: n for i, (n, _) in taken.items() if n})
