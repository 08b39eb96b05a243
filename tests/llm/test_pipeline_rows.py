"""The pipeline's stages on columns whose names they use themselves, odd rows, doubled and empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tilewright.llm import mixing

NAMES = ["target", "epochs", "source_size", "_source", "_copy", "copies", "_size", "_key", "_c", "_row", "_doc", "_id", "_from", "kept", "_stratum", "n", "rep", "key"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with odd rows and clashing columns, each with its number in all of these."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    texts = [text(r.randint(15, 80)) for _ in range(220)] + ["# $ | " * 30 + text(5)] * 3 + [None, "", "x", text(60_000)]
    rows = [(i if i % 50 else None, t, ["en", "de", None][i % 3], ["web", "books", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    number = F.xxhash64("doc_id", "text", "lang")
    docs = docs.withColumns({name: number for name in NAMES})
    folder = str(tmp_path_factory.mktemp("t"))
    spark.createDataFrame([(i, int(i < 220), 0) for i in range(0, 223)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), folder


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_columns_of_any_name_keep_their_values(spark, tables, name, stage):
    docs, folder = tables
    found = stage(spark, docs, folder)
    assert found.columns == docs.columns
    rows = found.collect()
    assert rows and all(len({r[c] for c in NAMES}) == 1 for r in rows)
    known = {(r["doc_id"], r["text"], r["lang"], r["target"]) for r in docs.collect()}
    assert {(r["doc_id"], r["text"], r["lang"], r["target"]) for r in rows} <= known


def test_doubled_tables_and_null_ids(spark, tables):
    docs, folder = tables
    stages = dict(corpus_pipeline.STAGES)
    once, count = stages["near_dedup"](spark, docs, folder), lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    with_null = docs.union(docs.select(F.lit(None).cast("long").alias("doc_id"), *docs.columns[1:]))
    told = count(once)
    for more in (docs.union(docs), with_null):
        found = count(stages["near_dedup"](spark, more, folder))
        plain = Counter({k: v for k, v in told.items() if (k[1] or "").split()})
        assert Counter({k: v for k, v in found.items() if (k[1] or "").split()}) == plain
    kept = count(stages["quality_classifier"](spark, docs, folder))
    assert count(stages["quality_classifier"](spark, docs.union(docs), folder)) == Counter({k: 2 * v for k, v in kept.items()})


def test_empty_tables_give_empty_stages(spark, tables):
    docs, folder = tables
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_mix_of_ties_and_refined_buckets(spark, tables):
    """However finely the end bucket is cut, the mix is the same; the given weights decide who is taken."""
    docs, _ = tables
    runs = [Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(docs, most_sorted=n).collect()) for n in (10**6, 3, 0)]
    assert runs[0] == runs[1] == runs[2]
    weight = F.when(F.col("n_chars") % 2 == 0, 1000.0).otherwise(0.001)
    rows = mixing.mix(docs, weight=weight).join(docs.select("doc_id", "n_chars"), "doc_id").where("size > 0 and target < source_size").collect()
    share = lambda odd: [r["taken"] > 0 for r in rows if r["n_chars"] % 2 == odd]
    assert sum(share(0)) / len(share(0)) > sum(share(1)) / len(share(1)) + 0.3


def test_last_stage_packs_all_words(spark, tables):
    docs, folder = tables
    found = corpus_pipeline.pack(spark, docs, folder).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r["doc_id"]] += len((r["text"] or "").split())
    packed = Counter()
    for r in found:
        packed[r["doc_id"]] += r["piece_len"]
    assert packed == sizes
