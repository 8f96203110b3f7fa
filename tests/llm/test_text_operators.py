"""BPE, language model, language ID and near-duplicates against the library, brute force or held-out accuracy."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from siftlane.llm import bpe, langid, lm, minhash  # noqa: E402
from siftlane.llm.common import word_hashes  # noqa: E402

PATH = public.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
ODD = ["", "it's we'll o'clock ''s 's's 'sabc don't x'RE 'Ve '' a'm <|endoftext|>'s", "a<|startoftext|>B <|endoftext|><|x|>", "ΑΣ Σ ΟΔΟΣ", "İstanbul ǅ ﬁ Å é ́", "a" * 700 + " " + "ab" * 300, "123 ½ ²³ Ⅷ\x00\x01", " \x85\xa0　x\x1cy​z", "😀😀 中文 ёж"]
DOCS = "doc_id long, text string, id string, digest string, lang string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def rows(texts, langs=None, first=0):
    return [(first + i, t, "clash", "clash", langs[i] if langs else None) for i, t in enumerate(texts)]


def noise(seed, n, alphabet="abcdeersth'!. 12éßñ中", most=60):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    with open(PATH, encoding="utf-8") as f:
        return bpe.WordBpe(f.read())


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(model, library):
    texts = ODD + noise(1, 3000) + noise(2, 40, "aelnorst", 600) + ["a" + chr(c) + "b " + chr(c) + " '" + chr(c) for c in range(1, 0x3000, 3)]
    for text, (ids, decoded), want in zip(texts, model.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids == model.encode_ids([text])[0].tolist(), repr(text[:60])
        assert decoded.decode() == library.decode(want.ids, skip_special_tokens=False) == model.decode(ids)


def test_speculation_and_exact_merging_agree_where_pairs_are_compatible(model):
    found = sorted({w for t in noise(3, 4000, "aeinorsth", 30) for w in t.split() if w})
    raw = [w.encode() for w in found]
    exact, of = model.merge_exactly(raw)
    greedy, g_of = model.speculate(raw)
    fine = [model.compatible(g[:-1], g[1:]).all() if len(g) > 1 else True for g in (greedy[g_of == i] for i in range(len(raw)))]
    same = [np.array_equal(exact[of == i], greedy[g_of == i]) for i in range(len(raw))]
    assert fine == same and any(fine) and not all(fine)
    assert all(model.merge_long(w) == exact[of == i].tolist() for i, w in enumerate(raw[:300]))


def test_every_token_is_its_own_encoding(model):
    names = [n.removesuffix("</w>") for n in model.names if n.endswith("</w>") and len(n) > 4]
    to_byte = bpe.byte_letters()
    raw = [bytes(to_byte[c] for c in n) for n in names]
    tokens, of = model.merge_exactly(raw)
    assert np.array_equal(of, np.arange(len(raw))) and [model.names[t] for t in tokens.tolist()] == [n + "</w>" for n in names]


def test_words_that_share_a_hash_are_told_apart(model, library, monkeypatch):
    weak = bpe.WordBpe(open(PATH, encoding="utf-8").read())
    monkeypatch.setattr(bpe, "span_hashes", lambda buf, first, last: ((last - first) % 3).astype(np.uint64))
    texts = [*ODD, *noise(11, 300)]
    for _ in range(2):
        for k in range(0, len(texts), 50):
            own = texts[k : k + 50]
            for (ids, decoded), want in zip(weak.encode(own), library.encode_batch(own, add_special_tokens=False), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == want.ids and decoded.decode() == library.decode(want.ids, skip_special_tokens=False)


def test_encode_long_texts_and_clashes(spark, library):
    long = " ".join(noise(12, 30000, "aeinorst", 9)) + " " + "z" * 30000
    df = spark.createDataFrame([(1, long, "x", "y", "z")], DOCS).withColumn("ids", F.lit(5)).withColumn("n_tokens", F.lit("n"))
    row = bpe.encode(df, PATH, keep=("doc_id", "ids", "n_tokens")).head()
    want = library.encode(long, add_special_tokens=False).ids
    assert (row.kept_ids, row.kept_n_tokens, row.n_tokens) == (5, "n", len(want)) and np.frombuffer(row.ids, "<u4").tolist() == want
    coded = bpe.encode(df, PATH).select("doc_id", "ids", F.col("decoded").alias("want"))
    back = bpe.decode(coded, PATH, keep=("doc_id", "want")).head()
    assert back.decoded == back.want == library.decode(want, skip_special_tokens=False)
    two = bpe.encode_ids(df, PATH, width=2).head()
    assert np.frombuffer(two.ids, "<u2").tolist() == want
    with pytest.raises(ValueError):
        bpe.encode_ids(df, PATH, width=3)


def test_encode_edges(spark, library):
    df = spark.createDataFrame([*rows([None, "", "Twice", "Twice"]), (None, "no id", None, None, None)], DOCS)
    got = bpe.encode(df, PATH).collect()
    assert [(r.doc_id, r.n_tokens, r.decoded) for r in got if not r.n_tokens] == [(0, 0, ""), (1, 0, "")]
    assert len(got) == 5 and {r.doc_id for r in got} == {0, 1, 2, 3, None} and len({bytes(r.ids) for r in got if r.doc_id in (2, 3)}) == 1
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_word_hashes():
    texts = [None, "", "One  two\x0bone", "x" * 5000 + " one", "é z É", "a " * 3000]
    hashes, counts = word_hashes(texts, most=1000)
    flat = [w for t in texts for w in words(t)]
    assert counts.tolist() == [len(words(t)) for t in texts]
    by = {}
    for w, h in zip(flat, hashes.tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [(len(sets[i]), find(i)) for i in range(len(texts))]


def copies(seed, groups=12, size=14, length=80):
    """Near copies at many similarities, exact copies, and odd texts."""
    r = random.Random(seed)
    out = [None, "", " \n", "one", "One", "one two", "two one", "x y z", "X\ty\x0bz"]
    for _ in range(groups):
        base = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(length)]
        out.append(" ".join(base))
        for _ in range(size):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 4, 6, 10])):
                w[r.randrange(length)] = "".join(r.choice("klm") for _ in range(5))
            out.append(" ".join(w) if r.random() < 0.8 else "\n".join(x.upper() for x in w))
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("k", "percent", "r", "b"), [(3, 85, 6, 20), (5, 80, 5, 24)])
def test_near_duplicates(spark, monkeypatch, k, percent, r, b):
    monkeypatch.setattr(minhash, "CHUNK", 5)  # so that groups take many tiles
    texts = copies(k)
    got = {x.id: x for x in minhash.near_duplicates(spark.createDataFrame(rows(texts), DOCS), shingle=k, percent=percent, rows=r, bands=b).collect()}
    want = brute_components(texts, k, percent)
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == dict(enumerate(want))
    assert all(x.kept == (x.id == x.component_id) for x in got.values())


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c d", "x", "x", None), (5, "a b c d", "x", "x", None), (3, "a b c d", "x", "x", None), (3, "a b c d", "x", "x", None), (9, None, "x", "x", None)], DOCS)
    got = sorted((r.id is None, r.id or 0, r.component_id, r.kept) for r in minhash.near_duplicates(df, shingle=3, percent=85).collect())
    assert got == [(False, 3, 3, True), (False, 3, 3, True), (False, 5, 3, False), (False, 9, 9, True), (True, 0, None, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_circulant_signatures_estimate_jaccard():
    r = np.random.default_rng(5)
    for shared in (100, 300, 450):
        a = r.integers(0, 1 << 63, 500, dtype=np.uint64)
        b = np.concatenate([a[:shared], r.integers(0, 1 << 63, 500 - shared, dtype=np.uint64)])
        s = minhash.circulant_signatures([a, b], 1024)
        assert abs((s[0] == s[1]).mean() - shared / (1000 - shared)) < 0.06


def test_language_model(spark):
    r = random.Random(9)
    grammar = {w: r.sample(range(60), 3) for w in range(60)}

    def text(n):
        w, out = r.randrange(60), []
        for _ in range(n):
            out.append(f"w{w}" if r.random() < 0.97 else f"rare{r.randrange(10**6)}")
            w = r.choice(grammar[w])
        return " ".join(out)

    texts = [None, "", "ONCE only", "é É " * 50, "dup dup"] + [text(r.randint(1, 120)) for _ in range(300)] + ["dup dup"]
    df = spark.createDataFrame([*rows(texts), (None, "no id", None, None, None)], DOCS).repartition(3)
    got = {x.id: x for x in lm.score(df, block_bytes=4000, bucket_bytes=3000).collect()}
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    tokens = {i: [*words(t), None] for i, t in enumerate(texts)} | {None: ["no", "id", None]}
    c = Counter(w for i, v in tokens.items() if fold(i) != 2 for w in v)
    total, kinds = sum(c.values()), len(c)
    assert set(got) == set(tokens)
    for i, v in tokens.items():
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (fold(i) == 2, len(v), sum(c[w] > 0 for w in v), total)
        assert math.isclose(x.base_score, sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in v), rel_tol=1e-9)
        assert math.isfinite(x.score)
    held = [x for x in got.values() if x.held_out]
    assert sum(x.score for x in held) > 0.7 * sum(x.base_score for x in held)
    again = {x.id: x.score for x in lm.score(df.repartition(1), block_bytes=1 << 20).collect()}
    assert all(math.isclose(again[i], got[i].score, rel_tol=1e-9) for i in got)  # however rows are dealt
    # The mixture itself, with given weights.
    given = np.random.default_rng(3).dirichlet([1, 1, 1], lm.BUCKETS)
    pairs = Counter((u, w) for i, v in tokens.items() if fold(i) != 2 for u, w in zip([None, *v[:-1]], v))
    for x in lm.score(df, block_bytes=5000, bucket_bytes=2000, weights=given).collect():
        want = 0.0
        for u, w in zip([None, *tokens[x.id][:-1]], tokens[x.id]):
            a, b, rest = given[1 + int(math.log2(c[u])) if c[u] else 0]
            want += math.log10((a * pairs[u, w] / c[u] if c[u] else 0) + b * c[w] / total + rest / (kinds + 1))
        assert math.isclose(x.score, want, rel_tol=1e-9)
    assert lm.score(df.limit(0)).count() == 0


def test_language_model_on_a_very_long_text(spark):
    long = " ".join(f"w{k % 5000}" for k in range(200_000))
    df = spark.createDataFrame([*rows([long, "w1 w2", None], first=1)], DOCS)
    got = {x.id: x for x in lm.score(df, block_bytes=1000, bucket_bytes=100_000).collect()}
    assert got[1].n_tokens == 200_001 and got[2].n_tokens == 3 and got[3].n_tokens == 1 and all(math.isfinite(x.score) for x in got.values())


def test_messages_are_in_proportion_to_the_corpus():
    count = lambda n: n / lm.sizes(n)[0] * n / lm.sizes(n)[1]
    for small, large in ((2 * 10**10, 2 * 10**11), (10**11, 10**12)):
        assert count(large) / count(small) < 10.5
    assert lm.sizes(10**14) == (lm.MOST_BYTES, lm.MOST_BYTES) and lm.sizes(0)[0] == lm.LEAST_BYTES


def test_mixture_weights_raise_the_likelihood():
    r = np.random.default_rng(1)
    events = [(int(b), int(p), int(w), int(n)) for b, p, w, n in zip(r.integers(0, 6, 300), r.integers(0, 60, 300), r.integers(30, 120, 300), r.integers(1, 9, 300), strict=True)]
    events += [(0, lm._ZERO, 50, 4), (3, lm._ZERO, lm._ZERO, 2)]

    def likelihood(weights):
        b, p, w, n = np.array(events).T
        f = np.stack([np.where(x == lm._ZERO, 0, 2.0 ** (-np.minimum(x, 999) / lm.STEPS)) for x in (p, w)] + [np.full(len(n), 1e-4)], 1)
        return (n * np.log((weights[b] * f).sum(1))).sum()

    steps = [likelihood(lm.fit_weights(events, 1e-4, k)) for k in (1, 3, 10, 60)]
    assert steps == sorted(steps) and np.allclose(lm.fit_weights(events, 1e-4).sum(1), 1)
    assert lm.fit_weights([], 1.0).shape == (lm.BUCKETS, 3)


def test_planes_round_trip():
    for v in (np.zeros(0, np.uint64), np.array([0, 1, 2**64 - 1, 255, 256], np.uint64), np.zeros(7, np.uint64)):
        assert np.array_equal(lm._unpack(lm._pack(v)), v)


def test_language_id(spark):
    r = random.Random(3)
    syllables = {"aa": ["ka", "ro", "ti", "mu"], "bb": ["sch", "ung", "ein", "ü"], "cc": ["é", "eau", "oi", "que"]}
    texts, langs = [], []
    for i in range(400):
        lang = ("aa", "bb", "cc")[i % 3]
        texts.append(" ".join("".join(r.choice(syllables[lang]) for _ in range(3)) for _ in range(30)))
        langs.append(lang)
    texts += [None, "", "12 !? ²", "karo " * 20000]
    langs += ["aa", "aa", None, None]
    df = spark.createDataFrame([*rows(texts, langs), (None, texts[1], None, None, None)], DOCS)
    got = {x.id: x for x in langid.predict(df, langid.fit(df), keep=("id", "text")).collect()}
    for i in (400, 401, 402):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[403].lang_pred == "aa" and got[None].lang_pred == "bb" and got[403].kept_id == "clash"
    held = [i for i in range(400) if got[i].held_out]
    assert len(held) > 40 and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    assert sum(got[i].lang_pred == langs[i] for i in held) / len(held) > 0.97
    assert not any(got[i].rejected for i in range(400)) and all(0 <= x.score <= 1 for x in got.values())
    assert {x.lang_pred for x in langid.predict(df, None).collect()} == {"und"}
    assert langid.fit(df.limit(0)) is None and langid.predict(df.limit(0), None).count() == 0


def test_logits_are_sums_over_grams():
    """The folded table against embeddings and layer n-gram by n-gram."""
    r = np.random.default_rng(2)
    embed, layer, bias = r.normal(size=(langid.BUCKETS, 4)), r.normal(size=(4, 3)), r.normal(size=3)
    seen = r.random(langid.BUCKETS) < 0.5
    model = langid.Model(["a", "b", "c"], embed @ layer, bias, seen)

    def gram_hash(gram):
        key = gram[0]
        for c in gram[1:]:
            key = (key * 0x01000193 & 0xFFFFFFFF) ^ c
        return ((key * 0x9E3779B1 & 0xFFFFFFFF) ^ len(gram)) >> 15

    texts = ["Ab c", "", "x", "one, Two3 ü!", "a" * 300]
    got, share = model.measure(texts)
    for text, z, part in zip(texts, got, share, strict=True):
        flat = bytes(32 if b < 128 and not chr(b).isalpha() else b + 32 if 65 <= b <= 90 else b for b in (" " + text + "     ").encode())
        found = [flat[i : i + n] for n in (2, 3, 4) for i in range(len(flat) - n + 1)]
        found = [g for g in found if 32 not in g[1:-1] and (g != b"  ")]
        hidden = np.mean([embed[gram_hash(g)] for g in found], axis=0) if found else np.zeros(4)
        assert np.allclose(z, hidden @ layer + bias)
        long = [g for g in found if len(g) == 4]
        assert math.isclose(part, (sum(bool(seen[gram_hash(g)]) for g in long) + langid.SPARE) / (len(long) + langid.SPARE))


def test_training_stays_finite_on_labels_that_cannot_be_told_apart():
    r = random.Random(1)
    texts, labels = [], []
    for k in range(25):
        for _ in range(26 if k < 4 else 230):
            texts.append(" ".join(r.choice(["aa", "bb", "cc", "dd"]) for _ in range(12)))
            labels.append(f"l{k:02}")
    model = langid.train(texts, labels, [i % 5 == 0 for i in range(len(texts))], epochs=3)
    p = model.probabilities(["aa bb", "zz", "cc dd"])
    assert np.isfinite(model.rows).all() and np.isfinite(p).all() and np.allclose(p.sum(1), 1)
    wild = langid.train(texts[:400], labels[:400], [i % 5 == 0 for i in range(400)], epochs=2, rate=1e9)
    assert np.isfinite(wild.probabilities(["aa bb"])).all()


def test_foreign_and_garbled_texts_are_rejected():
    r = random.Random(5)
    lexicon = {lang: ["".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(400)] for lang, letters in (("aa", "aeioklmnprst"), ("bb", "abdefghiou"), ("cc", "éèaoqurst"))}
    text = lambda lang, n: " ".join(r.choice(lexicon[lang]) for _ in range(n))
    labels = [("aa", "bb", "cc")[i % 3] for i in range(900)]
    texts = [text(x, r.randint(1, 120)) for x in labels]
    model = langid.train(texts, labels, [i % 5 == 0 for i in range(900)])
    clean = [text(x, r.randint(1, 200)) for x in labels]
    assert not model.judge(clean)[1].any()
    foreign = ["".join(r.choice("абвгдежзиклмнопрст ") for _ in range(300)) for _ in range(20)]
    garbled = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)) for _ in range(20)]
    assert model.judge(foreign)[1].all() and model.judge(garbled)[1].all()


def test_digests_of_queries_follow_from_outputs(spark, library):
    out = bpe.encode(spark.createDataFrame(rows(["Some text"]), DOCS), PATH).select(F.sha2("ids", 256).alias("a"), F.sha2("decoded", 256).alias("b")).head()
    want = library.encode("Some text", add_special_tokens=False).ids
    assert out.a == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert out.b == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
