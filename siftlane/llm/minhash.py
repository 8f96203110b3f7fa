"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all coordinates of a signature: the first scatters the shingles over a ring of
2^32 places, the second orders the places; coordinate k is the least rank among the document's places,
each moved k places round the ring. So one pass over a document's shingles gives every coordinate from
the same pair of permutations.

The plan: signatures (no shuffle) - one representative of each set of equal shingles - stars of the
documents that share a band - their components, which hold every candidate pair. A component of
CHUNK documents at most is verified pair by pair in one task, and its labels are final. A larger one is dealt
into cells of alike set sizes (sets in cells that aren't neighbours can't link) and chunks of a cell;
three rounds verify it, each on what the one before has joined:

1. each chunk alone, which gives its local classes;
2. each chunk against the first chunk of its cell, which joins the classes of one crowd of copies;
3. the largest class of the component is its core: all other documents meet one another and the core in
   tiles of two chunks; documents of the core never meet again.

A task returns one link for each two classes that it joins, so links are at most as many as documents
in rounds 1 and 2. All texts are shuffled once by id to meet the candidates, those of candidates once
more to their chunks; rounds 2 and 3 send sets of shingles. Round 3 grows with the
documents outside the core times the component, in tiles: that is the price of exactness for crowds of
documents just below the threshold.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlane.llm.common import mix64, slices, stage, unstage, word_hashes
from siftlane.llm.components import connected_components

#: Characters handled at once.
BLOCK = 1 << 20
#: Mean documents, and mean shingles, in a chunk at most; a tile holds two chunks.
CHUNK, CHUNK_SHINGLES = 256, 1 << 20
#: The rows of a component of many chunks meet its few rows of another table in so many tasks.
SALTS = 32
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; a shorter text is one shingle, one without words none."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    weight = mix64(np.arange(1, k + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
    if len(words) >= k:
        whole = np.zeros(len(words) - k + 1, np.uint64)
        for i in range(k):
            whole += words[i : len(words) - k + 1 + i] * weight[i]
        whole = mix64(whole)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(whole[end - n : end - k + 1]))
        elif n:
            own = words[end - n : end]
            out.append(mix64((own * weight[:n]).sum(dtype=np.uint64, keepdims=True) + mix64(np.full(1, n, np.uint64))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def circulant_signatures(sets: list[np.ndarray], size: int, seed: int = 1) -> np.ndarray:
    """A row of `size` 32-bit coordinates for each set, none of which may be empty."""
    first = mix64(np.concatenate(sets) + np.uint64(seed) * _GOLDEN)
    place = (first >> np.uint64(32)).astype(np.uint32)
    begin = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), size), np.uint32)
    for k in range(size):
        x = place - np.uint32(k)
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        out[:, k] = np.minimum.reduceat(x, begin)
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys of the bands, each from `rows` coordinates and the band's number."""
    bands = signatures.shape[1] // rows
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)[None, :] + np.uint64(1)
    for i in range(rows):
        key = mix64(key * _GOLDEN + parts[:, :, i])
    return key.view(np.int64)


def sketch(df: DataFrame, key: str, text: str, shingle: int, rows: int, bands: int) -> DataFrame:
    """id, n_shingles, digest (of the whole set) and bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in slices(texts, BLOCK):
                sets = shingle_sets(texts[begin:end], shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, band_keys(circulant_signatures([sets[i] for i in full], rows * bands), rows), strict=True):
                        keys[i] = row
                digest = [_digest(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n_shingles", "digest", "bands"])

    return df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "id long, n_shingles long, digest binary, bands array<long>")


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def linked_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links 100 * intersection >= percent * union among the sets: pairs of positions.

    Every pair of sets is either compared or known to be connected: a search from each set in turn
    compares it with all sets not yet reached.
    """
    size = np.array([len(s) for s in sets])
    distinct, code = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(size) - size
    left = np.arange(len(sets))
    out: list[tuple[int, int]] = []
    mark = np.zeros(len(distinct), bool)
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            own = code[begin[i] : begin[i] + size[i]]
            near = left[(100 * np.minimum(size[left], size[i]) >= percent * np.maximum(size[left], size[i]))]
            if not len(near):
                continue
            mark[own] = True
            n = size[near]
            at = np.cumsum(n) - n
            flat = np.repeat(begin[near] - at, n) + np.arange(n.sum())
            both = np.add.reduceat(mark[code[flat]].astype(np.int64), at)
            mark[own] = False
            hit = near[100 * both >= percent * (size[i] + n - both)]
            out += [(i, j) for j in hit.tolist()]
            queue += hit.tolist()
            left = np.setdiff1d(left, hit, assume_unique=True)
    return out


def roots_of(ids: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """For each position the least id that it reaches by pairs of positions."""
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b, key=ids.__getitem__)] = min(a, b, key=ids.__getitem__)
    return ids[[find(x) for x in range(len(ids))]]


def bridges(sets: list[np.ndarray], classes: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of classes joined by a link between a set of side 0 and one of side 1 (or, if there is no side 1, between any two).

    Each pair of sets is compared unless both are in one class or classes that are joined already; a
    pair of classes is given once, and none that follows from others.
    """
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(left):
        return []
    right = right if len(right) else left
    size = np.array([len(s) for s in sets])
    distinct, code = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(size) - size
    names, label = np.unique(classes, return_inverse=True)
    flat = np.concatenate([code[begin[j] : begin[j] + size[j]] for j in right.tolist()])
    at = np.cumsum(size[right]) - size[right]
    mark, out = np.zeros(len(distinct), bool), []
    for i in left.tolist():
        own = code[begin[i] : begin[i] + size[i]]
        open_ = (label[right] != label[i]) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i]))
        if not open_.any():
            continue
        mark[own] = True
        both = np.add.reduceat(mark[flat], at, dtype=np.int64)
        mark[own] = False
        for j in right[open_ & (100 * both >= percent * (size[i] + size[right] - both))].tolist():
            if label[j] != label[i]:
                out.append((int(classes[i]), int(classes[j])))
                label[label == label[j]] = label[i]
    return out


def _verify(percent: int):
    """For rows of class, side and shingles: the links (src, dst) of bridges()."""

    def run(group: pa.Table) -> pa.Table:
        found = bridges([np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()], group["class"].to_numpy(), group["side"].to_numpy(), percent)
        return pa.table({"src": pa.array([a for a, _ in found], pa.int64()), "dst": pa.array([b for _, b in found], pa.int64())})

    return run


def candidates(classes: DataFrame) -> DataFrame:
    """(node, component): the components of all nodes that share a band, for classes (node, bands).

    Each node is tied to the least of its bands' pivots, and the other pivots to that one, so there are
    as many edges as nodes and a few for the pivots, however many bands two nodes share.
    """
    shared = classes.select("node", F.explode("bands").alias("band"))
    pivots = shared.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select("band", "pivot")
    own = shared.join(pivots, "band").groupBy("node").agg(F.array_sort(F.collect_set("pivot")).alias("p"))  # at most one entry a band
    stars = own.select(F.explode(F.concat(F.array("node"), "p")).alias("src"), F.col("p")[0].alias("dst")).where("src <> dst").distinct()
    return connected_components(stars, "minhash-candidates")


def _chunks(n: Column, shingles: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / CHUNK), F.ceil(shingles / CHUNK_SHINGLES)).cast("int")


def spread_join(rows: DataFrame, few: DataFrame, on: list[str], by: str = "node") -> DataFrame:
    """rows joined with a table of a few rows for each key, which are repeated, so that a key with most of the rows isn't one task's."""
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def tiles(known: DataFrame) -> DataFrame:
    """component, a, b, side, class and shingles: known (node, class, component, cell, rest, shingles) dealt to tiles of two chunks of neighbouring cells, not both of the core."""
    cells = known.groupBy("component", "cell", "rest").agg(_chunks(F.count("*"), F.sum(F.octet_length("shingles") / 8)).alias("chunks"))
    # A component has as many cells as its sizes differ by powers of the threshold: some dozens.
    listed = cells.groupBy("component").agg(F.collect_list(F.struct("cell", "rest", "chunks")).alias("cells"))
    near = F.filter("cells", lambda c: (F.abs(c["cell"] - F.col("cell")) <= 1) & (c["rest"] + F.col("rest") > 0))
    mine = F.filter("cells", lambda c: (c["cell"] == F.col("cell")) & (c["rest"] == F.col("rest")))[0]["chunks"]
    place = lambda cell, rest, chunk: F.struct(cell.alias("cell"), rest.alias("rest"), chunk.cast("int").alias("chunk"))
    own = place(F.col("cell"), F.col("rest"), F.pmod(F.xxhash64("node", F.lit(5)), mine))
    others = F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0), c["chunks"] - 1), lambda k: place(c["cell"], c["rest"], k))))
    dealt = spread_join(known, listed, ["component"]).select("component", "class", "shingles", own.alias("own"), F.explode(others).alias("other"))
    return dealt.select("component", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"), "class", "shingles")


def join_crowds(first: DataFrame, percent: int) -> DataFrame:
    """(class, label): rounds 2 and 3, for first (node, class, component, cell, chunk, shingles)."""
    links = "src long, dst long"
    rows = first.select("node", "class", "component", "cell", "chunk", "shingles")

    # Round 2: each chunk meets the first of its cell, and that one the first of the cell below.
    asked = rows.select("component", F.when(F.col("chunk") == 0, F.col("cell") - 1).otherwise(F.col("cell")).alias("with"), "cell", "chunk").distinct()
    pivots = spread_join(rows.where("chunk = 0").select("node", "component", F.col("cell").alias("with"), "class", "shingles"), asked, ["component", "with"])
    met = rows.select("component", "cell", "chunk", "class", "shingles", F.lit(1).alias("side")).unionByName(pivots.select("component", "cell", "chunk", "class", "shingles", F.lit(0).alias("side")))
    crowds = connected_components(met.groupBy("component", "cell", "chunk").applyInArrow(_verify(percent), links), "minhash-crowds")
    known = rows.join(crowds.select("node", F.col("component").alias("mid")), rows["class"] == crowds["node"], "left").select(rows["node"], F.col("class").alias("was"), F.coalesce("mid", "class").alias("class"), "component", "cell", "shingles")

    # Round 3: all but the core meet one another and the core.
    cores = known.groupBy("component", "class").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("class", F.struct("n", "class")).alias("core"))
    known = stage(spread_join(known, cores, ["component"]).withColumn("rest", (F.col("class") != F.col("core")).cast("int")).drop("core"), "minhash-known")
    unstage(crowds)
    last = connected_components(tiles(known).groupBy("component", "a", "b").applyInArrow(_verify(percent), links), "minhash-bridges")
    names = known.select(F.col("was").alias("class"), F.col("class").alias("mid")).distinct()
    out = stage(names.join(last, names["mid"] == last["node"], "left").select("class", F.coalesce("component", "mid").alias("label")), "minhash-labels")
    unstage(known)
    unstage(last)
    return out


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, rows: int = 5, bands: int = 24) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links, itself included) and kept, for each row.

    Rows link whose sets of shingles have 100 * intersection >= percent * union, confirmed on the full
    sets. A text without words is linked with nothing, so is a row whose id is null (component_id null,
    kept). Equal sets are a class and are compared once; each row goes by its own text, also where
    several rows share an id. The bands miss a pair at the threshold with a probability of
    (1 - (percent/100)^rows)^bands: 0.00007 by default. A text of any length is read whole; one of more
    than CHUNK_SHINGLES shingles is a chunk by itself. An empty table gives an empty result; other
    columns are not read, whatever their names. The result is a staged table.
    """
    base = stage(sketch(df, key, text, shingle, rows, bands), "minhash-sketch")
    classes = base.where("n_shingles > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    # Linked sets differ in size by the threshold at most, so by one cell at most; the slack keeps rounding out.
    unit = max(1.0001 * math.log(100 / percent), 1e-6)
    found = candidates(classes)
    members = found.join(classes.drop("bands"), "node").withColumn("cell", F.floor(F.log("n_shingles") / unit))
    members = stage(members, "minhash-members")
    unstage(found)
    many = lambda *by: members.groupBy(*by).agg(_chunks(F.count("*"), F.sum("n_shingles")).alias("chunks"))
    place = many("component", "cell").join(many("component").select("component", (F.col("chunks") > 1).alias("split")), "component")
    placed = members.join(place, ["component", "cell"]).select("rep", "node", "digest", "component", "split", F.when(F.col("split"), F.col("cell")).otherwise(-1).alias("cell"), F.when(F.col("split"), F.pmod(F.xxhash64("node"), F.col("chunks"))).otherwise(0).cast("int").alias("chunk"))

    def alone(group: pa.Table) -> pa.Table:
        sets = shingle_sets(group["text"].to_pylist(), shingle)
        # Rows that share an id bring other texts too, or one text several times.
        own = {n: i for i, (n, d) in enumerate(zip(group["node"].to_pylist(), group["digest"].to_pylist(), strict=True)) if d == _digest(sets[i])}
        group, sets = group.take(list(own.values())), [sets[i] for i in own.values()]
        kept = [s.tobytes() if split else None for s, split in zip(sets, group["split"].to_pylist(), strict=True)]
        names = roots_of(group["node"].to_numpy(), linked_forest(sets, percent))
        return pa.table([group["node"], pa.array(names, pa.int64()), group["component"], group["cell"], group["chunk"], pa.array(kept, pa.binary())], ["node", "class", "component", "cell", "chunk", "shingles"])

    texts = df.select(F.col(f"`{key}`").cast("long").alias("rep"), F.col(f"`{text}`").cast("string").alias("text"))
    texts = texts.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    # Candidates grow with the table, so they are never broadcast; hashing them spares a sort of the texts.
    first = stage(texts.join(placed.hint("shuffle_hash"), "rep").groupBy("component", "cell", "chunk").applyInArrow(alone, "node long, class long, component long, cell long, chunk int, shingles binary"), "minhash-first")
    found = first.select("node", F.col("class").alias("label"))
    crowded, labels = first.where("shingles is not null"), None
    if crowded.head(1):
        labels = join_crowds(crowded, percent)
        found = first.join(labels, "class", "left").select("node", F.coalesce("label", "class").alias("label"))
    found = found.join(members.select("node", "rep"), "node")
    least = found.groupBy("label").agg(F.min("rep").alias("component"))
    found = found.join(least, "label").select("node", "component")
    named = classes.select("digest", "rep", "node").join(found, "node", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = base.drop("bands").join(named, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = stage(out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")), "minhash-result")
    for t in (base, classes, members, first, labels):
        if t is not None:
            unstage(t)
    return out
