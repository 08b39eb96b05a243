"""Token counts against the library's own ids."""

import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tilewright.llm import counting, queries
from tilewright.llm.counting import token_counts

SF_DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(rows, path=PATH):
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=repr)


def counted(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_tokens").collect()), key=repr)


def test_query_equals_the_library(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    found = queries.QUERIES["op12_token_counts"](spark, SF_DIR)
    assert counted(found) == plain(docs)
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in found.collect())


def _texts():
    r = random.Random(5)
    odd = ["", " ", "\n", "  ", "\t", "a", "B's", "'s", "don't", "é", "日本語", " ", " ", "x\x1cy", "<|endoftext|>", "<|endof", "12", "!?", "🙂", "\r\n", "²", "á"]
    return ["".join(r.choice(odd) + r.choice(["", " ", "\n", "  ", "\n\n"]) for _ in range(r.randint(1, 30))) for _ in range(400)]


ODD = [None, "", " ", "\n", "  a  b  ", "one two\nthree", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endoftext|><|endoftext|>", "x" * 50_000, "one two three " * 20_000]


@pytest.mark.parametrize("lot", [16_000_000, 300])
def test_odd_texts(spark, monkeypatch, lot):
    monkeypatch.setattr(counting, "LOT_BYTES", lot)
    rows = [(i // 2 if i % 7 else None, t) for i, t in enumerate([*ODD, *_texts(), *ODD[5:8]])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lot int, ids string")
    assert counted(token_counts(docs, PATH)) == plain(rows)
    assert counted(token_counts(docs.limit(0), PATH)) == []


def test_other_tokenizers(spark, tmp_path):
    """A normalizer with word ends, and an added token that takes the space before it."""
    rows = [(i, t) for i, t in enumerate([*ODD[:9], *_texts()[:60]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = public_tokenizers.path("word_bpe_49k.json")
    assert counted(token_counts(docs, words)) == plain(rows, words)
    settings = json.loads(open(PATH).read())
    settings["added_tokens"][0]["lstrip"] = True
    settings["truncation"] = {"direction": "Right", "max_length": 4, "strategy": "LongestFirst", "stride": 0}
    (tmp_path / "own.json").write_text(json.dumps(settings))
    assert counted(token_counts(docs, str(tmp_path / "own.json"))) == plain(rows, str(tmp_path / "own.json"))


def test_forgetful_workers_count_alike(monkeypatch):
    monkeypatch.setattr(counting, "REMEMBERED", 2)
    cutter = counting._Cutter(PATH)
    library = Tokenizer.from_file(PATH)
    for text in _texts()[:50]:
        found, special = cutter.frequencies(text)
        assert special + sum(n * cutter.n_pieces(w.encode()) for w, n in found.items()) == len(library.encode(text, add_special_tokens=False).ids)
