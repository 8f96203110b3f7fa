"""Language-model scores by deleted interpolation.

The model is P(w|u) = a c(u,w)/c(u) + b c(w)/N + c/(V+1): maximum-likelihood estimates of pairs and
words and a uniform share, mixed with weights (a, b, c) that depend on the bucket of c(u). The weights
are learned by expectation-maximisation: one fold of the training documents is deleted from the
counts, and the mixture is fitted to that fold's own tokens; the final model then counts every
training document.

How it scales: texts are packed into blocks; a block sends each distinct word and pair once, as sorted
64-bit hashes in a few compressed rows, to the bucket that counts that range of hashes; the bucket
answers every block with the counts in the block's own order. A frequent word is one entry of a block,
so no bucket is hot, and no vocabulary reaches the driver. Blocks and buckets both grow with the square
root of the corpus until a task's memory is the limit (MOST_BYTES, at about 1 TB), so a message stands
for MESSAGE bytes of text and their number is in proportion to the corpus. Beyond, messages get shorter;
as empty ones aren't sent, there are never more of them than distinct words and pairs of the blocks. Two words with one 64-bit hash (or two pairs
with one 56-bit hash) would be counted together; the chance per lookup is the number of distinct ones
over 2^64 (2^56).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.llm.common import fold, mix64, stage, word_hashes

#: The token that ends each text, which is also the context of its first word.
END = np.uint64(0x5E7D_0F7E_87A1_D0C5)
_TRAIN, _DELETED, _HELD = 0, 1, 2
#: Steps of an octave to which log-probabilities are rounded for the fit of the weights.
STEPS = 8
_ZERO = 1 << 20
#: Context-frequency buckets: 0, 1, 2-3, 4-7, ...
BUCKETS = 40
#: Text that a message stands for; text of a block, and of a bucket, at least and at most.
MESSAGE, LEAST_BYTES, MOST_BYTES = 4096, 6 << 20, 64 << 20


def sizes(corpus_bytes: int) -> tuple[int, int]:
    """Bytes of text of a block and of a bucket: their product is MESSAGE times the corpus, within the limits."""
    side = int((corpus_bytes * MESSAGE) ** 0.5)
    return min(MOST_BYTES, max(LEAST_BYTES, side)), min(MOST_BYTES, max(LEAST_BYTES * 4 // 3, side))


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit integers as compressed planes of bytes; planes of zeros are left out."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = max((i + 1 for i in range(8) if planes[i].any()), default=0)
    return struct.pack("<QB", len(values), used) + zstandard.ZstdCompressor(level=1).compress(planes[:used].tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    n, used = struct.unpack_from("<QB", raw)
    out = np.zeros((8, n), np.uint8)
    if used and n:
        out[:used] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[9:]), np.uint8).reshape(used, n)
    return np.ascontiguousarray(out.T).reshape(-1).view("<u8")


def _deltas(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def block_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens and of the pairs that end at them, and the tokens of each text, the end included."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts + 1) - 1
    tokens = np.full(len(words) + len(texts), END, np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = words
    before = np.concatenate([[END], tokens[:-1]]).astype(np.uint64) if len(tokens) else tokens
    pairs = mix64(before * np.uint64(0x9E3779B97F4A7C15) + tokens) >> np.uint64(8)
    return tokens, pairs, counts + 1


def pack_blocks(df: DataFrame, key: str, text: str, held: tuple[int, int], deleted: int, block_bytes: int) -> DataFrame:
    """Rows of many texts each, compressed, apart by role: counted, deleted for the fit, or held out."""
    modulus, remainder = held
    role = fold(key, modulus)
    role = F.when(role == remainder, _HELD).when(role == deleted, _DELETED).otherwise(_TRAIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        open_blocks: dict[int, tuple[list, list[bytes]]] = {}
        size, serial, part = {}, 0, TaskContext.get().partitionId()

        def close(r: int) -> pa.RecordBatch:
            nonlocal serial
            ids, raw = open_blocks.pop(r)
            size.pop(r)
            block = part << 32 | serial
            serial += 1
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(raw))
            meta = np.array([[0 if i is None else i, i is None, len(x)] for i, x in zip(ids, raw, strict=True)], "<i8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([r], pa.int32()), pa.array([sum(map(len, raw))], pa.int64()), pa.array([meta], pa.binary()), pa.array([body], pa.binary())], ["block", "role", "n_bytes", "meta", "body"])

        for batch in batches:
            for i, t, r in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids, raw = open_blocks.setdefault(r, ([], []))
                ids.append(i)
                raw.append((t or "").encode())
                size[r] = size.get(r, 0) + len(raw[-1]) + 8
                if size[r] >= block_bytes:
                    yield close(r)
        for r in list(open_blocks):
            yield close(r)

    return df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), role.cast("int").alias("role")).mapInArrow(run, "block long, role int, n_bytes long, meta binary, body binary")


def _open(meta: bytes, body: bytes) -> tuple[np.ndarray, list[str]]:
    rows = np.frombuffer(meta, "<i8").reshape(-1, 3)
    raw, ends = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, int(rows[:, 2].sum()))) if rows[:, 2].sum() else b"", np.cumsum(rows[:, 2])
    return rows, [raw[e - n : e].decode() for e, n in zip(ends.tolist(), rows[:, 2].tolist(), strict=True)]


def _cut(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where the keys of each bucket begin: buckets are equal ranges of the hashes."""
    edge = np.array([(k << bits) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edge), [len(keys)]])


def count_blocks(blocks: DataFrame, word_buckets: int, pair_buckets: int) -> DataFrame:
    """The counts of each block's words and pairs in the corpus, and rows of totals (block null).

    bucket below word_buckets: words, then pairs. total: counts in all training texts; gone: of them, in deleted ones.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, role, meta, body in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                tokens, pairs, _ = block_tokens(_open(meta, body)[1])
                out: list[tuple] = []
                for values, bits, buckets, first in ((tokens, 64, word_buckets, 0), (pairs, 56, pair_buckets, word_buckets)):
                    keys, counts = np.unique(values, return_counts=True)
                    at = _cut(keys, bits, buckets)
                    out += [(first + k, block, role, _pack(_deltas(keys[a:b])), _pack(counts[a:b])) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "block", "role", "keys", "counts"])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        keys = [np.cumsum(_unpack(x), dtype=np.uint64) for x in group["keys"]]
        ends = np.cumsum([len(k) for k in keys])
        roles = group["role"].to_numpy()
        counts = np.concatenate([_unpack(x) if r != _HELD else np.zeros(len(k), np.uint64) for x, r, k in zip(group["counts"], roles, keys, strict=True)]).astype(float)
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(back, counts, len(distinct)).astype(np.uint64)
        gone = np.bincount(back, counts * np.repeat(roles == _DELETED, np.diff(ends, prepend=0)), len(distinct)).astype(np.uint64)
        rows = []
        for block, role, end, k in zip(group["block"], roles, ends.tolist(), keys, strict=True):
            own = back[end - len(k) : end]
            rows.append((block, group["bucket"].iloc[0], _pack(total[own]), _pack(gone[own]) if role == _DELETED else None, 0, 0, 0, 0))
        rows.append((None, group["bucket"].iloc[0], None, None, total.sum(), (total > 0).sum(), gone.sum(), (total > gone).sum()))
        out = pd.DataFrame(rows, columns=["block", "bucket", "total", "gone", "n_tokens", "n_types", "n_gone", "n_left"])
        return out.astype({"block": "Int64"})

    sent = blocks.select("block", "role", "meta", "body").mapInArrow(send, "bucket int, block long, role int, keys binary, counts binary")
    return sent.groupBy("bucket").applyInPandas(answer, "block long, bucket int, total binary, gone binary, n_tokens long, n_types long, n_gone long, n_left long")


def _looked_up(tokens: np.ndarray, pairs: np.ndarray, answers: pd.DataFrame, word_buckets: int, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The counts of each token and of each pair."""
    out = []
    for values, own in ((tokens, answers[answers["bucket"] < word_buckets]), (pairs, answers[answers["bucket"] >= word_buckets])):
        counts = np.concatenate([_unpack(x) for x in own.sort_values("bucket")[column]])
        out.append(counts[np.unique(values, return_inverse=True)[1]].astype(float))
    return out[0], out[1]


def _context(words: np.ndarray, counts: np.ndarray, of_end: float) -> np.ndarray:
    """The counts of each token's context: of the token before, or of the end for a text's first."""
    before = np.concatenate([[of_end], words[:-1]])
    before[np.cumsum(counts)[:-1]] = of_end
    return before


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0, then 1 + floor(log2 of the context's count)."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64).clip(0, BUCKETS - 1)


def _steps(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.round(-STEPS * np.log2(np.maximum(p, 1e-300))), _ZERO).astype(np.int64)


def fit_weights(events: list[tuple[int, int, int, int]], uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights of pair, word and uniform estimates by bucket, from (bucket, pair step, word step, count) by expectation-maximisation."""
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    if not events:
        return weights
    bucket, pair, word, n = np.array(events, np.int64).T
    p = np.stack([np.where(x == _ZERO, 0.0, 2.0 ** (-np.where(x == _ZERO, 0, x) / STEPS)) for x in (pair, word)] + [np.full(len(n), uniform)], axis=1)
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / share.sum(axis=1))[:, None]
        mass = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)], axis=1)
        # A tiny prior keeps every share positive, so no text has a probability of nought.
        mass += np.array([0.02, 0.02, 0.01]) * (np.arange(BUCKETS)[:, None] > 0) + np.array([0.0, 0.02, 0.01]) * (np.arange(BUCKETS)[:, None] == 0)
        weights = mass / mass.sum(axis=1, keepdims=True)
    seen = np.bincount(bucket, n, BUCKETS) > 0
    for b in range(2, BUCKETS):  # frequencies that the deleted fold never had: as the bucket below
        if not seen[b]:
            weights[b] = weights[b - 1]
    return weights


def score(df: DataFrame, key: str = "doc_id", text: str = "text", held: tuple[int, int] = (7, 2), deleted: int = 3, block_bytes: int | None = None, bucket_bytes: int | None = None, weights: np.ndarray | None = None) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row's whole text.

    held: modulus and remainder of crc32(key as text) that keep a row out of the model; deleted: the
    remainder of the training rows whose tokens fit the weights. A null text counts as empty (its end is
    its one token), a null key as empty text in the hash. Repeated rows each count. An empty table gives
    an empty result; other columns are not read, whatever their names. A block holds about block_bytes of
    text (one text at least, however long); a bucket's share of the hashes is that of bucket_bytes of
    text; both follow from the corpus where they aren't given. weights: BUCKETS rows of three, instead of
    those that are fitted.
    """
    own = F.col(f"`{text}`").cast("string")
    if block_bytes is None or bucket_bytes is None:
        corpus = df.agg(F.coalesce(F.sum(F.octet_length(own).cast("long") + 8), F.lit(0))).head()[0]
        block_bytes, bucket_bytes = (given or found for given, found in zip((block_bytes, bucket_bytes), sizes(corpus), strict=True))
    blocks = stage(pack_blocks(df, key, text, held, deleted, block_bytes), "lm-blocks")
    size = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).head()[0]
    pair_buckets = max(4, -(-size // bucket_bytes))
    word_buckets = max(1, pair_buckets // 4)
    answers = stage(count_blocks(blocks, word_buckets, pair_buckets), "lm-answers")
    sums = answers.where(f"block is null and bucket < {word_buckets}").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_types", "n_gone", "n_left")]).head()
    n_tokens, n_types, n_gone, n_left = map(int, sums)
    answers = answers.where("block is not null").select("block", "bucket", "total", "gone")

    def features(block: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        _, texts = _open(block["meta"].iloc[0], block["body"].iloc[0])
        tokens, pairs, counts = block_tokens(texts)
        (words, both), (words_gone, both_gone) = (_looked_up(tokens, pairs, own, word_buckets, c) for c in ("total", "gone"))
        words, both = words - words_gone, both - both_gone
        context = _context(words, counts, words[counts[0] - 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            pair = np.where(context > 0, both / np.maximum(context, 1), 0)
        word = words / max(1, n_tokens - n_gone)
        found, n = np.unique(np.stack([bucket_of(context), _steps(pair), _steps(word)], axis=1), axis=0, return_counts=True)
        return pd.DataFrame({"b": found[:, 0], "p": found[:, 1], "w": found[:, 2], "n": n})

    deleted_blocks = blocks.where(F.col("role") == _DELETED)
    events = deleted_blocks.select("block", "meta", "body").groupBy("block").cogroup(answers.where("gone is not null").groupBy("block")).applyInPandas(features, "b long, p long, w long, n long")
    # At most BUCKETS x (64 STEPS + 1)^2 rows, whatever the corpus: a histogram of rounded probabilities.
    # In one order, so that the sums of the fit don't depend on how the rows were dealt.
    if weights is None:
        weights = fit_weights(sorted(tuple(r) for r in events.groupBy("b", "p", "w").agg(F.sum("n")).collect()), 1 / (n_left + 1))

    def scored(block: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows, texts = _open(block["meta"].iloc[0], block["body"].iloc[0])
        tokens, pairs, counts = block_tokens(texts)
        words, both = _looked_up(tokens, pairs, own, word_buckets, "total")
        context = _context(words, counts, words[counts[0] - 1])
        mix = weights[bucket_of(context)]
        p = mix[:, 0] * both / np.maximum(context, 1) + mix[:, 1] * words / max(1, n_tokens) + mix[:, 2] / (n_types + 1)
        begin = np.cumsum(counts) - counts
        base = np.log10((words + 1) / (n_tokens + (n_types + 1)))
        out = pd.DataFrame({"id": pd.array(rows[:, 0], "Int64"), "held_out": block["role"].iloc[0] == _HELD, "n_tokens": counts, "n_known": np.add.reduceat((words > 0).astype(np.int64), begin), "train_tokens": n_tokens, "base_score": np.add.reduceat(base, begin), "score": np.add.reduceat(np.log10(p), begin)})
        out.loc[rows[:, 1] == 1, "id"] = pd.NA
        return out

    return blocks.select("block", "role", "meta", "body").groupBy("block").cogroup(answers.drop("gone").groupBy("block")).applyInPandas(scored, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
