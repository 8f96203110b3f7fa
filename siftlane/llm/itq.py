"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations of the leading principal axes are learned so that the signs of the rotated coordinates make
balanced binary codes that keep angles. The code is cut into substrings, one table for each: a pair is
retrieved where a substring is equal. Vectors of a table's cell are reranked against one another by the
cosine of the original vectors in double precision; a pair counts in the first table that holds it.

The substrings' width follows the logarithm of the rows of the largest label, so that a cell holds a few
chance neighbours whatever the table's size, and the number of tables follows from the width and from
the share of bits by which sample pairs at the threshold differ, so that MISS of such pairs are missed.
A cell that is large all the same, as of a crowd of near copies, is dealt into tiles of two chunks and
verified by matrix products: a task returns a row for each vector (its links, and the least vector it
reaches), never pairs.

Equal vectors with equal labels form a class and are retrieved once; the number of links of a vector is
its class's other members and all members of the linked classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.llm.common import stage, unstage
from siftlane.llm.components import connected_components

#: The rotations are fitted on so many vectors at most, those with the least hashes of their ids. All vectors are indexed.
SAMPLE = 4096
#: A smaller sample teaches no rotation.
LEAST_SAMPLE = 256
#: Share of the pairs at the threshold that no table may hold, by the sample's estimate.
MISS = 0.002
#: Tables at most: beyond, substrings get narrower and cells larger, so that nothing more is missed.
MOST_TABLES = 96
#: Mean vectors in a chunk of a cell; a tile holds two chunks.
CHUNK = 1024
#: Cosines as near to the threshold as this are summed exactly.
NEAR = 1e-12


def fit_rotation(sample: np.ndarray, bits: int, rounds: int = 20, seed: int = 7, centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Mean (0 if not centred), and the matrix whose product's signs are the code's bits."""
    mean = sample.mean(axis=0) * centred
    x = sample - mean
    _, axes = np.linalg.eigh(x.T @ x / max(1, len(x)))
    axes = axes[:, ::-1][:, :bits]
    v = x @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (left @ right).T
    return mean, axes @ turn


def rotations(sample: np.ndarray, bits: int, threshold: float = 0.93, differ: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and as many rotations side by side, each from another start, as give so many bits.

    Vectors that all point alike are torn apart by centring. So rotations are learned on centred
    vectors, or on the vectors as they are, whichever way pairs at the threshold differ in no more than
    a share `differ` of the bits; or are random, as for a small sample, where that share is the angle's.
    """
    length = sample.shape[1]
    each, times = min(length, bits), range(-(-bits // min(length, bits)))
    for centred in (True, False):
        if len(sample) >= LEAST_SAMPLE and bit_difference(sample, threshold, centred) <= differ:
            parts = [fit_rotation(sample, each, seed=7 + k, centred=centred) for k in times]
            return parts[0][0], np.concatenate([turn for _, turn in parts], axis=1)[:, :bits]
    rng = np.random.default_rng(length)
    return np.zeros(length), np.concatenate([np.linalg.qr(rng.normal(size=(length, length)))[0][:, :each] for _ in times], axis=1)[:, :bits]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; each is first divided by its largest component, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bit_difference(sample: np.ndarray, threshold: float, centred: bool = True, seed: int = 3) -> float:
    """The share of a code's bits by which pairs at the threshold differ: made from the sample's vectors, turned towards random directions and towards other vectors of the sample, the larger share of the two."""
    rng = np.random.default_rng(seed)
    x = sample[:1024]
    mean, turn = fit_rotation(sample, min(sample.shape[1], 64), centred=centred)
    out = [0.0]
    for away in (rng.normal(size=x.shape), np.roll(x, 1, axis=0) - np.roll(x, 2, axis=0)):
        away = away - (away * x).sum(axis=1, keepdims=True) * x
        size = np.sqrt((away * away).sum(axis=1, keepdims=True))
        fine = size[:, 0] > 1e-9
        y = threshold * x[fine] + math.sqrt(max(0.0, 1 - threshold**2)) * away[fine] / size[fine]
        if len(y):
            out.append(float((((x[fine] - mean) @ turn >= 0) != ((y - mean) @ turn >= 0)).mean()))
    return max(out)


def expected_difference(sample: np.ndarray, threshold: float) -> float:
    """The share of bits by which pairs at the threshold differ, by which tables are laid out: the angle's as for random hyperplanes, or the sample's if that is larger, but not by much."""
    angle = math.acos(max(-1.0, min(1.0, threshold))) / math.pi + 0.005
    found = [bit_difference(sample, threshold, c) for c in (True, False)] if len(sample) >= LEAST_SAMPLE else []
    return max([angle, *(x for x in found[:1] if x <= 1.5 * angle)])


def shape_of_tables(rows: int, differ: float) -> tuple[int, int]:
    """(width of a substring, number of tables) for the largest label's rows and the share of differing bits at the threshold."""
    differ = min(0.45, max(0.01, differ))
    width = min(40, max(6, math.ceil(math.log2(max(2, rows))) + 2))
    while True:
        tables = math.ceil(math.log(MISS) / math.log(1 - (1 - differ) ** width))
        if tables <= MOST_TABLES or width <= 2:
            return width, tables
        width -= 1


class _Coder:
    """Substrings of the codes of vectors of any length."""

    def __init__(self, fitted: dict[int, tuple[np.ndarray, np.ndarray]], width: int, tables: int):
        self.fitted, self.width, self.tables = fitted, width, tables

    def substrings(self, x: np.ndarray) -> np.ndarray:
        """A row of `tables` integers for each unit vector."""
        length = x.shape[1]
        if length not in self.fitted:
            self.fitted[length] = rotations(np.zeros((0, length)), self.width * self.tables)
        mean, turn = self.fitted[length]
        bits = ((x - mean) @ turn >= 0).reshape(len(x), self.tables, self.width)
        return (bits.astype(np.int64) << np.arange(self.width)).sum(axis=2)


def linked(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs of unit vectors of x and y, or of x alone, whose cosine reaches the threshold."""
    cosine = x @ (x if y is None else y).T
    if y is None:
        cosine[np.tril_indices(len(x))] = -2
    i, j = np.nonzero(cosine >= threshold - NEAR)
    value = cosine[i, j]
    fine = value >= threshold
    for k in np.flatnonzero(np.abs(value - threshold) < NEAR).tolist():  # too near to leave it to the order of a sum
        v, w = x[i[k]], (x if y is None else y)[j[k]]
        fine[k] = math.fsum(v * w) / math.sqrt(math.fsum(v * v) * math.fsum(w * w)) >= threshold
    return i[fine], j[fine]


def least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For positions 0 to n - 1 the least that each reaches by the pairs."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


TILE = ("label", "length", "t", "sub", "a", "b")


def _begins(table: pa.Table) -> np.ndarray:
    """Where the tiles of a table sorted by tile begin."""
    coded = [table[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("label", "sub")]
    keys = [*coded, *(table[c].to_numpy() for c in ("length", "t", "a", "b"))]
    return np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))


def rerank(table: pa.Table, threshold: float) -> pa.Table:
    """node, links and root of the vectors that link within the tiles of table: rows sorted by tile."""
    begin = _begins(table)
    end = np.append(begin[1:], len(table))
    node, copies, side, of, diagonal = (table[c].to_numpy() for c in ("node", "copies", "side", "t", "a"))
    diagonal = diagonal == table["b"].to_numpy()
    subs = np.stack([np.frombuffer(s, np.int64) for s in table["subs"].to_pylist()])
    raw, lengths = table["vector"].to_pylist(), table["length"].to_numpy()
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        """Of linked pairs those that no earlier table holds."""
        for k in range(0, len(i), 1 << 15):
            a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            first = ~((subs[a] == subs[b]) & (np.arange(subs.shape[1]) < of[a][:, None])).any(axis=1)
            pairs.append((a[first], b[first]))

    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        x = unit(np.stack([np.frombuffer(raw[k], np.float64) for k in rows.tolist()]))
        at = np.zeros(len(table), np.int64)
        at[rows] = np.arange(len(rows))
        mine = (lengths[begin] == length) & (end - begin > 1)
        # Tiles of two rows, which are most, at once.
        two = begin[mine & (end - begin == 2)]
        two = two[diagonal[two] | (side[two] != side[two + 1])]
        value = np.einsum("ij,ij->i", x[at[two]], x[at[two + 1]])
        keep(two[value >= threshold + NEAR], two[value >= threshold + NEAR] + 1)
        tiles = [(b, b + 2) for b in two[np.abs(value - threshold) < NEAR].tolist()]
        more = mine & (end - begin > 2)
        for b, e in [*tiles, *zip(begin[more].tolist(), end[more].tolist(), strict=True)]:
            own = np.arange(b, e)
            left, right = (own, None) if diagonal[b] or e - b == 2 else (own[side[b:e] == 0], own[side[b:e] == 1])
            if len(left) and (right is None or len(right)):
                i, j = linked(x[at[left]], None if right is None else x[at[right]], threshold)
                keep(left[i], (left if right is None else right)[j])
    i, j = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    names, place = np.unique(node, return_inverse=True)
    links = np.zeros(len(names), np.int64)
    np.add.at(links, place[i], copies[j])
    np.add.at(links, place[j], copies[i])
    root = least_reached(len(names), place[i], place[j])
    there = links > 0
    return pa.table({"node": names[there], "links": links[there], "root": names[root[there]]})


def rerank_sorted(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """rerank() of batches sorted by tile; a tile may go on in the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        cut = int(_begins(table)[-1]) if len(table) else 0
        held = table.slice(cut)
        if cut:
            yield from rerank(table.slice(0, cut), threshold).to_batches()
    if held is not None and len(held):
        yield from rerank(held, threshold).to_batches()


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93) -> DataFrame:
    """id, n_links (other rows linked directly), component_id (smallest id reachable) and kept, for each row.

    Rows link when their labels are equal and not null, their vectors equally long, and the cosine is at
    least the threshold. Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing; nor do rows whose id is null (component_id null, kept). Finite components may have any
    size. Each row goes by its own vector, also where rows share an id; rows with the same id, label and
    vector count once. Links found are links; MISS of those at the threshold are missed by the sample's
    estimate (tests and the README give measured recall). An empty table gives an empty result; other
    columns are not read, whatever their names. The result is a staged table.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(finite & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))
    most = rows.where(good).groupBy("label").count().agg(F.max("count")).head()[0] or 0
    sample = rows.where(good).select("vector", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).select("vector").collect()
    by: dict[int, list] = {}
    for r in sample:
        by.setdefault(len(r[0]), []).append(r[0])
    by = {n: unit(np.array(v, float)) for n, v in by.items()}
    widest = max(by, key=lambda n: len(by[n]), default=0)
    differ = expected_difference(by[widest] if widest else np.zeros((0, 1)), threshold)
    width, tables = shape_of_tables(most, differ)
    coder = _Coder({n: rotations(v, width * tables, threshold, differ) for n, v in by.items()}, width, tables)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors, fine = batch.columns
            raw: list = [None] * len(batch)
            subs: list = [None] * len(batch)
            digest: list = [None] * len(batch)
            groups: dict[int, list[int]] = {}
            for i, ok in enumerate(fine.to_pylist()):
                if ok:
                    groups.setdefault(len(vectors[i]), []).append(i)
            for own in groups.values():
                x = np.array(vectors.take(pa.array(own)).to_pylist(), float) + 0.0  # no negative noughts
                for i, v, s in zip(own, x, coder.substrings(unit(x)), strict=True):
                    raw[i], subs[i] = v.tobytes(), s.tobytes()
                    digest[i] = hashlib.blake2b(raw[i], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(digest, pa.binary()), pa.array(subs, pa.binary()), pa.array(raw, pa.binary())], ["id", "label", "digest", "subs", "vector"])

    coded = stage(rows.withColumn("fine", good).select("id", "label", "vector", "fine").mapInArrow(encode, "id long, label string, digest binary, subs binary, vector binary"), "itq-codes")
    classes = coded.where("digest is not null").groupBy("label", "digest").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"), F.first("subs").alias("subs"), F.first("vector").alias("vector"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("length", (F.octet_length("vector") / 8).cast("int")), "itq-classes")

    # A cell is a table's substring among the vectors of a label and a length.
    cell = list(TILE[:4])
    each = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.struct(t.alias("t"), F.substring("subs", t * 8 + 1, F.lit(8)).alias("sub")))
    index = classes.select("node", "label", "length", F.explode(each).alias("x")).select("node", "label", "length", "x.t", "x.sub")
    cells = index.groupBy(*cell).agg(F.count("*").alias("n")).where("n > 1").select(*cell, F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.col("chunks")).cast("int")
    dealt = index.join(cells, cell).select(*cell, "node", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select(*cell, "node", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    sent = dealt.join(classes.select("node", "copies", "subs", "vector"), "node").repartition(*TILE).sortWithinPartitions(*TILE)
    found = stage(sent.select(*TILE, "side", "node", "copies", "subs", "vector").mapInArrow(lambda batches: rerank_sorted(batches, threshold), "node long, links long, root long"), "itq-links")
    roots = found.groupBy("node").agg(F.sum("links").alias("near"), F.array_sort(F.collect_set("root")).alias("roots"))
    ends = roots.select(F.explode(F.concat(F.array("node"), "roots")).alias("src"), F.col("roots")[0].alias("dst")).where("src <> dst").distinct()
    joined = connected_components(ends, "itq-components")
    named = classes.select("label", "digest", "rep", "copies", "node").join(roots.select("node", "near"), "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component").select("label", "digest", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), "least")
    out = coded.select("id", "label", "digest").join(named, ["label", "digest"], "left")
    component = F.coalesce("least", "id")
    out = stage(out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")), "itq-result")
    for t in (coded, classes, found, joined):
        unstage(t)
    return out
