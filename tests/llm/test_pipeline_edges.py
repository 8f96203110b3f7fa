"""Every stage on nulls in any column, empty and long texts, repeats, ties, empty tables and clashing columns."""

import random

import corpus_pipeline
import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, rejected string, `__row` int, component_id int, ids string"


def rows():
    r = random.Random(3)
    lexicon = {x: ["".join(r.choice(s) for _ in range(3)) for _ in range(60)] for x, s in (("aa", ["ka", "ro", "ti", "mu"]), ("bb", ["sch", "ung", "ein", "ab"]))}
    text = lambda lang, n: " ".join(r.choice(lexicon[lang]) for _ in range(n))
    out = [(k, text(("aa", "bb")[k % 2], r.randint(15, 60)), ("aa", "bb")[k % 2], f"src{k % 3}") for k in range(160)]
    long = text("aa", 30000)
    out += [(500, long, "aa", "src1"), (501, long + " more", None, None), (None, out[3][1], "bb", None), (None, text("aa", 40), None, "x"), (3, out[3][1], "bb", "src0"), (3, out[3][1], "bb", "src0")]
    out += [(600, None, "aa", "src0"), (601, "", None, None), (602, " 12 !?", "aa", "src0"), (None, None, None, None), (603, "абв где жзи " * 30, None, "src0")]
    return [(*x, None, "i", "r", 1, 2, "z") for x in out]


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(rows(), COLUMNS)
    first = corpus_pipeline.language_id(spark, docs, "")
    assert first.columns == docs.columns
    kept = [(x.doc_id, x.text) for x in first.collect()]
    want = sorted(((x[0], x[1]) for x in rows() if x[1] and any(c.isascii() and c.isalpha() for c in x[1])), key=repr)
    assert sorted(kept, key=repr) == want
    second = corpus_pipeline.near_duplicates(spark, docs, "")
    assert second.columns == docs.columns
    got = [(x.doc_id, x.text) for x in second.collect()]
    three = rows()[3][1]
    assert [i for i, t in got if t == three] == [3] and [i for i, t in got if t and len(t) > 50000] == [500]
    assert sorted((i for i, t in got if not t), key=str) == [600, 601, None] and len(got) == 160 + 1 + 1 + 5
    third = corpus_pipeline.mixing_weights(spark, second, "")
    assert third.columns == docs.columns and 60 < third.count() < second.count()
    last = {x.doc_id: x for x in corpus_pipeline.encoding(spark, second, "").collect()}
    assert len(last[600].ids) == 0 == last[601].n_tokens and len(np.frombuffer(last[500].ids, "<u4")) == last[500].n_tokens > 30000


def test_run_on_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], COLUMNS)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, "").count() == 0
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
