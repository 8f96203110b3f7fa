"""Packing, sharding, mixing, media, chat, vectors and the pipeline against brute force and their laws."""

import bisect
import hashlib
import itertools
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlane.llm import chat, itq, media, mixing, packing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, slot int"


def docs(spark, texts, langs=None, sources=None, ids=None):
    return spark.createDataFrame([((ids or range(len(texts)))[i], t, (langs or ["en"] * len(texts))[i], (sources or ["src1"] * len(texts))[i], None, "x", 7) for i, t in enumerate(texts)], DOCS)


def brute_bins(lengths, row):
    rooms = []
    for length in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, length)
        room = rooms.pop(k) if k < len(rooms) else row
        bisect.insort(rooms, room - length)
    return len(rooms)


def test_best_fit_decreasing_is_that_of_single_items():
    r = random.Random(4)
    for row in (7, 64, 1000):
        for _ in range(30):
            lengths = [r.randint(1, row - 1) for _ in range(r.randint(0, 300))] + [r.randint(1, max(1, row // 9))] * r.randint(0, 90)
            runs, bins = packing.best_fit_decreasing([(x, lengths.count(x)) for x in set(lengths)], row)
            assert bins == brute_bins(lengths, row)
            used = defaultdict(list)
            for length, low, high, first, each, at in runs:
                for k in range(high - low):
                    used[first + k // each].append((at + k % each * length, length))
            assert sorted(x for v in used.values() for _, x in v) == sorted(lengths) and set(used) == set(range(bins))
            for v in used.values():
                ends = [0]
                for at, length in sorted(v):
                    assert at == ends[-1]
                    ends.append(at + length)
                assert ends[-1] <= row


def test_capacity_tree():
    tree, r, have = packing.CapacityTree(50), random.Random(2), []
    for _ in range(400):
        x = r.randint(0, 50)
        if have and r.random() < 0.4:
            tree.add(have.pop(r.randrange(len(have))), -1)
        else:
            tree.add(x, 1)
            have.append(x)
        need = r.randint(1, 50)
        assert tree.least(need) == min((h for h in have if h >= need), default=-1)


@pytest.mark.parametrize("width", [1, 4])
def test_packing_loses_nothing(spark, width):
    r = random.Random(width)
    texts = ["ab" * r.randint(0, 90) for _ in range(120)] + [None, "", "x" * 64, "y" * 640, "z" * 641]
    ids = F.encode(F.repeat("text", width), "UTF-8")
    out = packing.pack(docs(spark, texts), row=64, ids=ids, width=width).collect()
    found = defaultdict(dict)
    for x in out:
        assert len(x.input_ids) == 64 * width and x.cu_seqlens[-1] == x.n_tokens and x.position_resets == x.cu_seqlens[:-1]
        for i, s, a, b in zip(x.doc_ids, x.starts, x.cu_seqlens, x.cu_seqlens[1:]):
            found[i][s] = bytes(x.input_ids[a * width : b * width])
    for i, t in enumerate(texts):
        assert b"".join(found[i][s] for s in sorted(found[i])) == ((t or "") * width).encode()
    rest = [len(t or "") % 64 for t in texts if len(t or "") % 64]
    assert sorted(x.bin for x in out if x.bin is not None) == list(range(brute_bins(rest, 64)))
    assert packing.matrix([x.input_ids for x in out], 1).shape == (len(out), 64 * width)
    assert packing.position_ids([0, 2, 5], 6).tolist() == [0, 1, 0, 1, 2, 0]


def test_packing_edges(spark, tmp_path):
    df = docs(spark, ["abc", "abc", "abcdefghij"], ids=[None, None, 1])
    out = packing.pack(df, row=8, ids=F.encode("text", "UTF-8"))
    assert sorted(bytes(x.input_ids) for x in out.collect()) == [b"abcabcij", b"abcdefgh"]
    packing.write_packed(out, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert packing.pack(df.limit(0), row=8, ids=F.encode("text", "UTF-8")).count() == 0


def test_sharding(spark):
    r = random.Random(8)
    texts = ["é" * r.randint(0, 400) for _ in range(900)] + [None, "", "same"] + ["same"] * 300
    df = docs(spark, texts)
    out = sharding.shard(df, 16).collect()
    sizes, places = defaultdict(int), defaultdict(list)
    for x in out:
        t = texts[x.id] or ""
        assert x.size == len(t.encode()) + 1 and x.text_crc32 == zlib.crc32(t.encode()) and x.virtual_slot == zlib.crc32(str(x.id).encode()) % 4096
        sizes[x.shard] += x.size
        places[x.shard].append(x.place)
    assert len(out) == len(texts) and set(sizes) == set(range(16))
    assert max(sizes.values()) < 1.01 * sum(sizes.values()) / 16
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard(df.limit(0), 16).count() == 0
    twice = sharding.shard(docs(spark, ["a", "a", None], ids=[None, None, None]), 2).collect()
    assert len({x.shard for x in twice}) == 1 and sorted(x.place for x in twice) == [0, 1, 2]


def test_versions_of_maps_are_kept(spark, tmp_path):
    sizes = spark.createDataFrame([(k, 10 + k % 7) for k in range(60)], "slot int, bytes long")
    path = f"file://{tmp_path}/maps"
    assert sharding.map_versions(spark, path) == [] and sharding.save_map(sharding.new_map(sizes, 4), path) == 1
    assert sharding.save_map(sharding.rebalance(sharding.load_map(spark, path), sizes, 5), path) == 2 and sharding.map_versions(spark, path) == [1, 2]
    old, new = ({r.slot: r.shard for r in sharding.load_map(spark, path, v).collect()} for v in (1, None))
    moved = [new[k] for k in old if new[k] != old[k]]
    assert len(old) == len(new) == 60 and 9 <= len(moved) < 20 and moved.count(4) > 0.8 * len(moved)
    with pytest.raises(ValueError, match="version 1"):
        sharding.save_map(sharding.load_map(spark, path, 1), path)


def test_rows_without_a_key_are_numbered_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 10)
    df = docs(spark, ["x"] * 300 + [f"t{k}" for k in range(100)], ids=[None] * 300 + list(range(100)))
    out = sharding.shard(df, 4).collect()
    by = defaultdict(list)
    for x in out:
        by[x.shard].append(x.place)
    assert len(out) == 400 and all(sorted(p) == list(range(len(p))) for p in by.values())
    assert len({x.shard for x in out if x.id is None}) == 1


def test_rebalancing_moves_few_slots(spark):
    r = random.Random(1)
    sizes = {s: r.randint(50, 150) for s in range(400)}
    frame = lambda d: spark.createDataFrame([(k, v) for k, v in d.items()], "slot int, bytes long")
    first = sharding.new_map(frame(sizes), 8)
    old = {x.slot: x for x in first.collect()}
    loads = defaultdict(int)
    for s, x in sorted(sizes.items(), key=lambda p: (-p[1], p[0])):  # largest first onto the least loaded
        k = min(range(8), key=lambda j: (loads[j], j))
        assert old[s].shard == k
        loads[k] += x
    grown = {s: v * (3 if old[s].shard == 0 else 1) for s, v in sizes.items()}
    new = {x.slot: x for x in sharding.rebalance(first, frame(grown), 8).collect()}
    load = [sum(grown[s] for s in grown if new[s].shard == k) for k in range(8)]
    moved = {s for s in sizes if new[s].shard != old[s].shard}
    assert max(load) < 1.05 * sum(load) / 8 and {x.version for x in new.values()} == {2} and set(new) == set(sizes)
    assert len(moved) < 60 and sum(old[s].shard == 0 for s in moved) > 0.8 * len(moved)
    more = {x.slot: x.shard for x in sharding.rebalance(first, frame(sizes), 9).collect()}
    assert {more[s] for s in sizes if more[s] != old[s].shard} == {8}


def fill(children, total):
    """Shares of a total by weight, none above its capacity; whole numbers, children by capacity over weight."""
    order = sorted(children, key=lambda c: (c[1] / c[2], c[0]))
    out, mass = {}, sum(w for _, _, w in children)
    for k, (name, cap, w) in enumerate(order):
        if cap * mass <= w * max(total, 0):
            out[name] = cap
            total, mass = total - cap, mass - w
        else:
            for n, c, v in order[k:]:
                out[n] = min(c, v * total // mass)
            break
    return out


def test_mixing(spark):
    r = random.Random(6)
    n = 700
    langs = [r.choice(["en", "en", "en", "de", "xx", None]) for _ in range(n)]
    sources = [r.choice(["src0"] * 6 + ["src1", "src2", "src5", "src7", "other", None]) for _ in range(n)]
    texts = [r.choice(["one two three", "w " * r.randint(0, 40), None, " \t", "a\x0bb"]) for _ in range(n)]
    out = mixing.mix(docs(spark, texts, langs, sources), share=0.9, epochs=2, seed=3).collect()
    tokens = [len((t or "").replace("\x0b", " ").split()) for t in texts]
    leaf_of, leaves = {}, defaultdict(int)
    for i in range(n):
        s = sources[i] or ""
        leaf_of[i] = (f"d{int(s[3:]) % 4 if s.startswith('src') else 0}", langs[i] or "", s)
        leaves[leaf_of[i]] += tokens[i]
    leaves = {k: v for k, v in leaves.items() if v}
    unit = mixing.UNIT
    weight = lambda table, x: round(table.get(x, mixing.OTHER) * unit)
    cap = lambda *p: 2 * sum(v for k, v in leaves.items() if k[: len(p)] == p)
    tops = fill([(d, cap(d), weight(mixing.DOMAIN_WEIGHTS, d)) for d in sorted({k[0] for k in leaves})], int(sum(tokens) * 0.9))
    given = {}
    for d, total in tops.items():
        for lang, part in fill([(x, cap(d, x), weight(mixing.LANG_WEIGHTS, x)) for x in sorted({k[1] for k in leaves if k[0] == d})], total).items():
            for s, v in fill([(k[2], 2 * t, round(mixing.OTHER * unit)) for k, t in leaves.items() if k[:2] == (d, lang)], part).items():
                given[d, lang, s] = v
    want = set()
    for leaf, total in given.items():
        own = [i for i in range(n) if leaf_of[i] == leaf and tokens[i]]
        for epoch in range(2):
            left = total - epoch * leaves[leaf]
            for i in sorted(own, key=lambda i: (hashlib.md5(f"3:{epoch}:{i}".encode()).hexdigest(), str(i))):
                left -= tokens[i]
                if left < 0:
                    break
                want.add((i, epoch, total))
    assert {(x.id, x.epoch, x.given) for x in out} == want and len(out) == len(want) > 100
    assert mixing.mix(docs(spark, [None, ""])).count() == 0 and mixing.mix(docs(spark, ["a"]).limit(0)).count() == 0


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("d0", "en", "s1", 10), ("d0", "en", "s2", 1000), ("d0", "de", "s3", 1000), ("d1", "en", "s4", 1000)], "domain string, lang string, source string, tokens long")
    weights = {"domain": {"d0": 0.5, "d1": 0.5}, "lang": {"en": 0.5, "de": 0.5}}
    got = {x.source: x.given for x in mixing.budgets(leaves, 800, 1, weights).collect()}
    assert got == {"s1": 10, "s2": 190, "s3": 200, "s4": 400}


def test_media(spark):
    r = random.Random(2)
    texts = [None, "", "same", "same", "é" * 96, "x" * 193, "".join(chr(r.randint(32, 1000)) for _ in range(9000))]
    out = {x.doc_id: x for x in media.analyse(media.store(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = (t or "").encode()
        want += b" " * ((-len(want)) % 192 or (192 if not want else 0))
        assert bytes(out[i].samples) == want and len(out[i].media) == len(want) + 44 and bytes(out[i].media[:4]) == b"RIFF"
        assert len(out[i].peak_times) == len(out[i].peak_codes) and out[i].peak_times == sorted(out[i].peak_times)
    assert out[2].peak_codes == out[3].peak_codes and len(out[6].peak_codes) > 50
    alone = media.fingerprints([bytes(out[6].samples)])[0]
    assert alone[1].tolist() == out[6].peak_codes  # neighbours in a batch don't matter
    assert media.analyse(media.store(docs(spark, ["a"]).limit(0))).count() == 0
    clash = media.analyse(media.store(docs(spark, texts).withColumn("samples", F.lit(1)).withColumn("media", F.lit("m")), keep=("doc_id", "samples", "media")))
    assert clash.columns == ["doc_id", "kept_media", "media", "samples", "peak_times", "peak_codes"] and clash.count() == len(texts)
    nothing = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert media.analyse(nothing).head().peak_codes is None
    with pytest.raises(Exception):
        media.from_wav(b"no sound")


def test_fingerprints_equal_a_plain_transform():
    """Peaks and pairs from a transform summed by its definition, frame by frame."""
    r = np.random.default_rng(7)
    t = np.arange(2000)
    sounds = [(128 + 40 * np.sin(t * 0.7) + 30 * np.sin(t * 1.9) * (t > 900) + r.normal(0, 8, 2000)).clip(0, 255).astype(np.uint8).tobytes(), r.integers(0, 256, 700, dtype=np.uint8).tobytes(), b" " * 192, bytes([128]) * 400]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.FRAME) / (media.FRAME - 1))
    wave = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME), np.arange(1, media.FRAME // 2 + 1)) / media.FRAME)
    width = media.FRAME // 2 // media.BANDS
    for sound, (times, codes) in zip(sounds, media.fingerprints(sounds), strict=True):
        x = np.frombuffer(sound, np.uint8).astype(float) - 128
        frames = max(1, -(-(len(x) - media.FRAME) // media.HOP) + 1)
        x = np.pad(x, (0, (frames - 1) * media.HOP + media.FRAME - len(x)))
        power = np.array([np.abs((x[k * media.HOP : k * media.HOP + media.FRAME] * window) @ wave) ** 2 for k in range(frames)])
        peaks = []
        for k in range(frames):
            for band in range(media.BANDS):
                own = power[:, band * width : (band + 1) * width].max(axis=1)
                low, high = max(0, k - media.REACH), k + media.REACH + 1
                if own[k] > 1e-3 and own[k] >= own[low:high].max() * (1 - 1e-9) and not (own[low:k] >= own[k] * (1 - 1e-9)).any():
                    peaks.append((k, band * width + int(power[k, band * width : (band + 1) * width].argmax())))
        want = sorted((a, fa << 13 | fb << 6 | b - a) for i, (a, fa) in enumerate(peaks) for b, fb in peaks[i + 1 : i + 1 + media.FAN] if b - a <= media.FARTHEST)
        assert list(zip(times.tolist(), codes.tolist())) == want


def test_fingerprints_find_tones_in_time():
    t = np.arange(8000)
    tone = (128 + 60 * np.sin(2 * np.pi * 1000 / 8000 * t) * (t > 4000)).astype(np.uint8).tobytes()
    times, codes = media.fingerprints([tone])[0]
    assert len(codes) and ((codes >> 13) == 31).any() and times.max() >= 30  # bin 31 from 0: 1000 Hz


def conversations(spark, n, seed):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        roles = (["system"] if r.random() < 0.3 else []) + ["user", "assistant"] * r.randint(1, 3)
        for k, role in enumerate(roles):
            size = {"system": 6, "user": 10, "assistant": 45}[role]
            rows.append((c, k, role, "\n".join(" ".join("Word" if i == 0 else "w" for i in range(r.randint(2, size))) + ("?" if role == "user" else ".") for _ in range(1 if role != "assistant" else 3))))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat(spark):
    raw = chat.transcripts(conversations(spark, 400, 5)).cache()
    model = chat.fit(chat.training_rows(raw))
    out = chat.parse(raw, model, keep=("id", "segment", "true_roles")).collect()
    held = [x for x in out if zlib.crc32(str(x.id).encode()) % 5 == 0]
    assert sum(x.roles == x.true_roles for x in held) / len(held) > 0.85
    x = next(x for x in out if x.roles == x.true_roles)
    assert x.rendered == chat.render(list(zip(x.roles, x.bodies))) and x.rendered.count("<|end|>") == len(x.roles)
    odd = spark.createDataFrame([(1, None), (2, " \n"), (3, "User: hi\nassistant: yo\nmore"), (3, "User: hi\nassistant: yo\nmore")], "id long, text string")
    got = chat.parse(odd, model).collect()
    assert [len(x.roles) for x in got] == [0, 0, 2, 2] and got[2].roles == ["user", "assistant"] and got[2].bodies == ["hi", "yo\nmore"] and got[0].rendered == ""
    clash = odd.withColumn("roles", F.lit(7))
    assert chat.parse(clash, model, keep=("id", "roles")).columns == ["id", "kept_roles", "roles", "bodies", "rendered"]
    nulls = spark.createDataFrame([(None, None, None, None), (1, 5, "user", None), (1, 5, "user", None)], "conv_id long, turn long, role string, text string")
    assert chat.transcripts(nulls).count() == 2
    assert chat.transcripts(nulls.limit(0)).count() == 0 and chat.fit(raw.limit(0)) is not None


def test_long_and_unordered_conversations(spark):
    """Borders of transcripts don't change roles, and rows without an order are dealt to bounded pieces."""
    model = chat.fit(chat.training_rows(chat.transcripts(conversations(spark, 300, 8))))
    n = 1400
    rows = [(5, k, "user" if k % 2 == 0 else "assistant", "What is it now?" if k % 2 == 0 else " ".join(["It"] + ["w"] * 40) + ".") for k in range(n)]
    raw = chat.transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    parts = sorted(chat.parse(raw, model, keep=("segment", "text"), before="before", after="after").collect(), key=lambda x: x.segment)
    assert [len(x.text.split("\n")) for x in parts] == [512, 512, 376]
    whole = chat.turns_of("\n".join(x.text for x in parts), model)
    assert [r for x in parts for r in x.roles] == [r for r, _ in whole]
    odd = [(None, None, "user", "same")] * 1500 + [(7, 3, "assistant", f"t{k}") for k in range(700)] + [(8, 1, "user", "x")]
    got = chat.transcripts(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")).collect()
    assert sum(len(x.true_roles) for x in got) == len(odd) and max(len(x.true_roles) for x in got) < 700
    assert sorted({(x.id or 0, x.piece) for x in got}) == [(0, 0), (0, 1), (0, 2), (7, 0), (7, 1), (8, 0)]
    assert sorted(t for x in got if x.id == 7 for t in x.text.split("\n")) != [] and all(x.before == x.after == "" for x in got)


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(3)
    model = chat.Hmm(r.normal(size=chat.STATES), r.normal(size=(chat.STATES, chat.STATES)), [r.normal(size=(chat.STATES, n)) for n in (chat.KINDS, chat.LENGTHS, chat.ENDINGS, chat.FIRSTS)])
    seen = np.stack([r.integers(0, n, 4) for n in (chat.KINDS, chat.LENGTHS, chat.ENDINGS, chat.FIRSTS)], axis=1)

    def value(path):
        emit = sum(e[s, seen[i, k]] for i, s in enumerate(path) for k, e in enumerate(model.emissions))
        return model.starts[path[0]] + emit + sum(model.moves[a, b] for a, b in zip(path, path[1:]))

    best = max(itertools.product(range(chat.STATES), repeat=4), key=value)
    assert tuple(model.viterbi(seen)) == best


def vectors(seed, n=900, d=64):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, d))
    for k in range(0, n, 3):  # copies at cosines around the threshold
        u, v = base[k] / np.linalg.norm(base[k]), r.normal(size=d)
        v -= (v @ u) * u
        c = r.choice([0.9, 0.929, 0.931, 0.94, 0.97, 0.995])
        base[(k + 1) % n] = (c * u + np.sqrt(1 - c * c) * v / np.linalg.norm(v)) * r.uniform(0.5, 3)
    base[5:25] = base[5]
    return base.astype(np.float32)


def test_near_vectors(spark):
    x = vectors(1)
    labels = [None if i % 50 == 7 else i % 4 if i > 30 else 1 for i in range(len(x))]
    for k in range(0, len(x), 3):
        labels[(k + 1) % len(x)] = labels[k]
    rows = [(i, v.tolist(), labels[i], "x", "y") for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 1, "x", "y"), (n + 1, [0.0] * 64, 1, "x", "y"), (n + 2, [float("nan")] + [1.0] * 63, 1, "x", "y"), (n + 3, [None] + [1.0] * 63, 1, "x", "y"), (n + 4, [float("inf")] * 64, 1, "x", "y"), (n + 5, [1.0], 1, "x", "y"), (n + 6, [], 1, "x", "y"), (None, x[0].tolist(), labels[0], "x", "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string, code string")
    got = {r.id: r for r in itq.near_vectors(df).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    same = np.array([[a is not None and a == b for b in labels] for a in labels])
    near = (y @ y.T >= 0.93) & same
    np.fill_diagonal(near, False)
    links = np.array([got[i].n_links for i in range(n)])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.98 * near.sum() and near.sum() > 500
    exact = [i for i in range(n) if links[i] != near[i].sum()]
    assert len(exact) < 0.02 * n
    for i in range(n, n + 7):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].component_id is None and {got[i].component_id for i in range(5, 25)} == {got[5].component_id} and got[5].n_links >= 19
    assert itq.near_vectors(df.limit(0)).count() == 0


def test_rotation_balances_bits():
    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 16)) @ r.normal(size=(16, 16))
    mean, turn = itq.fit_rotation(x, 16)
    bits = (x - mean) @ turn >= 0
    assert (np.abs(bits.mean(0) - 0.5) < 0.1).all()


def exact_links(x, labels, threshold=0.93):
    y = np.asarray(x, float)
    y = y / np.abs(y).max(axis=1, keepdims=True)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (y @ y.T >= threshold) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(near, False)
    return near.sum(1)


def test_vectors_of_any_size_and_length(spark):
    """Components as large as 1e160 and as small as 1e-170, and vectors of other lengths."""
    r = np.random.default_rng(4)
    a = r.normal(size=8)
    far = a.copy()
    far[:4] += 0.55 * np.linalg.norm(a) * np.array([1, -1, 1, -1]) / 2
    rows = [(0, a * 1e160), (1, a * 1e160 * 1.5), (2, far * 1e160), (3, a * 1e-170), (4, a), (5, np.array([1.0, 2.0])), (6, np.array([1.0, 2.0])), (7, np.array([2.0, 4.000001])), (8, np.array([5e-324] + [0.0] * 7)), (9, np.array([-3.0])), (10, np.array([-7.0])), (11, np.array([7.0])), (12, np.full(8, 1.7e308))]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in rows] + [(13, a.tolist(), 2), (14, a.tolist(), None), (4, (-a).tolist(), 1)], "vec_id long, embedding array<double>, label int")
    got = sorted((x.id, x.n_links, x.component_id) for x in itq.near_vectors(df).collect())
    want = dict.fromkeys(range(15), 0)
    eight = [0, 1, 2, 3, 4, 8, 12]
    by = dict(rows)
    for i, n in zip(eight, exact_links([by[i] / np.abs(by[i]).max() for i in eight], [1] * len(eight))):
        want[i] = n
    want |= {5: 2, 6: 2, 7: 2, 9: 1, 10: 1}
    assert want[0] == want[1] == want[3] == want[4] == 3 and want[2] == 0
    assert [(i, n) for i, n, _ in got] == sorted([*want.items(), (4, 0)])
    assert {(i, c) for i, _, c in got} >= {(1, 0), (3, 0), (4, 0), (6, 5), (7, 5), (10, 9), (11, 11), (2, 2)}


@pytest.mark.parametrize("mean", [0.0, 1.0, 2.0])
def test_recall_with_a_common_direction(spark, mean):
    """Near vectors are found also where all vectors point alike (mean cosines of 0, 0.5 and 0.8)."""
    r = np.random.default_rng(6)
    x = r.normal(size=(1200, 32)) / np.sqrt(32) + mean * np.eye(32)[0]
    for k in range(0, 1200, 2):
        u, v = x[k] / np.linalg.norm(x[k]), r.normal(size=32)
        v -= (v @ u) * u
        c = r.choice([0.93, 0.935, 0.95, 0.98]) + 1e-6
        x[k + 1] = c * u + np.sqrt(1 - c * c) * v / np.linalg.norm(v)
    labels = (np.arange(1200) // 2 % 3).tolist()
    df = spark.createDataFrame([(i, v.tolist(), labels[i]) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    want = exact_links(x, labels)
    got = {y.id: y.n_links for y in itq.near_vectors(df).collect()}
    links = np.array([got[i] for i in range(1200)])
    assert (links <= want).all() and links.sum() >= 0.98 * want.sum() and want.sum() >= 1200


def test_a_crowd_of_near_vectors_is_counted_whole(spark, monkeypatch):
    """Tiles of two chunks: every pair counts once."""
    monkeypatch.setattr(itq, "CHUNK", 16)
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=24) + 0.12 * r.normal(size=(150, 24)), r.normal(size=(50, 24))])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {y.id: (y.n_links, y.component_id) for y in itq.near_vectors(df).collect()}
    want = exact_links(x, [1] * 200)
    links = np.array([got[i][0] for i in range(200)])
    assert (links <= want).all() and links.sum() >= 0.99 * want.sum() and want.sum() > 15000
    assert {got[i][1] for i in range(150)} == {0}


def test_tables_follow_the_rows():
    assert itq.shape_of_tables(2000, 0.12)[0] < itq.shape_of_tables(60000, 0.12)[0]
    for rows, differ in ((1, 0.12), (10**4, 0.12), (10**6, 0.12), (10**9, 0.12), (10**6, 0.3), (10**6, 0.5)):
        width, tables = itq.shape_of_tables(rows, differ)
        assert width >= 2 and (1 - (1 - min(0.45, differ)) ** width) ** tables <= itq.MISS * 1.001
    r = np.random.default_rng(1)
    x = itq.unit(r.normal(size=(3000, 64)))
    alike = itq.unit(x + 0.25)
    assert 0.1 < itq.bit_difference(x, 0.93) < 0.15 < itq.bit_difference(alike, 0.93) and itq.bit_difference(alike, 0.93, centred=False) < 0.2
    assert 0.12 < itq.expected_difference(alike, 0.93) < 0.19 and itq.expected_difference(x[:9], 0.93) < 0.13
    mean, turn = itq.rotations(x, 200)
    assert turn.shape == (64, 200) and itq.rotations(np.zeros((0, 3)), 10)[1].shape == (3, 10)
    i, j = r.integers(0, 50, 40), r.integers(0, 50, 40)
    root = itq.least_reached(50, i, j)
    assert (root[i] == root[j]).all() and (root <= np.arange(50)).all() and (root[root] == root).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    public = pytest.importorskip("public_tokenizers")
    import tokenizers

    from tests_helper_brute import brute_components

    assert 4 <= len(pipeline.STAGES) <= 5
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = pipeline.language_id(spark, d, "").collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in d.collect()}  # all of these are clean
    second = pipeline.near_duplicates(spark, d, "")
    rows = sorted(d.collect(), key=lambda r: r.doc_id)
    roots = brute_components([r.text for r in rows], 5, 80)
    assert {r.doc_id for r in second.collect()} == {r.doc_id for r, root in zip(rows, roots) if rows[root].doc_id == r.doc_id}
    third = pipeline.mixing_weights(spark, second, "")
    assert third.columns == d.columns and 0 < third.count() <= second.count()
    out = {r.doc_id: r for r in pipeline.run(spark, "/root/testdata/sf0.001").collect()}
    assert set(out) == {r.doc_id for r in third.collect()}
    t = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    for r in third.collect():
        ids = t.encode(r.text, add_special_tokens=False).ids
        assert bytes(out[r.doc_id].ids) == np.array(ids, "<u4").tobytes()
