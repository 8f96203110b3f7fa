"""One document of each group stays, also where ids are null or repeated."""

import random

import corpus_pipeline


def test_near_duplicates_without_distinct_ids(spark):
    r = random.Random(4)
    text = lambda: " ".join(r.choice("abcdefghij") * r.randint(1, 9) for _ in range(120))
    a, b, c, d = text(), text(), text(), text()
    rows = [(None, a), (None, a), (None, a + " end"), (7, b), (7, b), (7, b), (9, c), (2, c), (None, c), (None, d), (4, d), (5, None), (5, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "aa", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = [(x.doc_id, x.text) for x in got.collect()]
    assert len([t for _, t in kept if t and t.startswith(a)]) == 1
    by = lambda t: [i for i, x in kept if x == t]
    assert (by(b), by(c), by(d)) == ([7], [2], [4])
    assert by(None) == [5, 5] and by("") == [None]
