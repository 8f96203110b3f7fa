"""Language identification by averaged hashed subword embeddings and a linear softmax.

Every byte n-gram of a word (2 to 4 bytes, word borders included) is hashed to a row of an embedding
table; a text's vector is the mean of its rows, and a linear layer with softmax gives the languages'
probabilities. Embeddings and layer are trained by stochastic gradient descent in numpy. As both are
linear, embeddings and layer fold into one table of scores for each n-gram, by which texts are scored.
A temperature fitted on texts kept apart calibrates the probability.

A text is rejected for one of three reasons: it is null or has no letter; its best probability is below
the model's limit; or too few of its longest n-grams occur in the training texts (foreign or garbled
text, whose probability may be high all the same). Both limits come from the texts kept apart and lie
well below what those show, so clean text of a learned language stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlane.llm.common import fold, slices

BUCKETS = 1 << 17
SIZES = (2, 3, 4)
DIMENSIONS = 16
#: Bound of the sample of labelled texts: so many for each language, and so many in all.
PER_LANGUAGE, MOST_SAMPLE = 300, 6000
BLOCK = 1 << 20
#: A class's weight in training, at most; a score of an n-gram beyond which a descent counts as failed.
MOST_WEIGHT, MOST_SCORE = 10.0, 1e6
#: Of a text's longest n-grams so many count as seen besides those that are.
SPARE = 4
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes that are no part of a word: all of ASCII but letters.
_GAP = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def gram_ids(buf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, the hashes of the n-grams that start at each byte, and whether they count."""
    buf = _FOLD[buf]
    gap = _GAP[buf]
    x = np.where(gap, np.uint8(32), buf).astype(np.uint32)
    key, ok = x.copy(), np.ones(len(x), bool)
    for n in range(1, max(SIZES)):
        key = key[:-1] * np.uint32(0x01000193) ^ x[n:]
        # a border is the first or last byte of an n-gram, never inside
        ok = ok[:-1] & ~gap[n - 1 : len(x) - 1] if n > 1 else ~(gap[:-1] & gap[1:])
        if n + 1 in SIZES:
            h = key * np.uint32(0x9E3779B1)
            yield (h ^ np.uint32(n)) >> np.uint32(15), ok


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(" " + t + "     ").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


class Model:
    """languages, rows (scores of each n-gram), bias, seen (the n-grams of training texts), temperature and limits."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, seen: np.ndarray | None = None, temperature: float = 1.0, limit: float = 0.0, least_seen: float = 0.0):
        self.languages, self.bias, self.temperature, self.limit, self.least_seen = languages, bias, temperature, limit, least_seen
        self.rows = np.concatenate([table, np.zeros((1, len(languages)), table.dtype)])  # the last row: n-grams that don't count
        self.seen = np.append(np.ones(BUCKETS, bool) if seen is None else seen, False)

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of logits for each text (without n-grams: the bias alone), and the share of its longest n-grams that training texts have.

        SPARE n-grams count as seen besides, so that a few unknown words don't decide on a short text.
        """
        buf, begin = _joined(texts)
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for ids, ok in gram_ids(buf):
            at = np.where(ok, ids, BUCKETS)
            total += np.add.reduceat(self.rows[at], begin[:-1], axis=0, dtype=np.float64)
            own = np.add.reduceat(ok, begin[:-1], dtype=np.int64)
            n += own
            share = (np.add.reduceat(self.seen[at], begin[:-1], dtype=np.int64) + SPARE) / (own + SPARE)
        return total / np.maximum(n, 1)[:, None] + self.bias, share

    def logits(self, texts: list[str]) -> np.ndarray:
        return self.measure(texts)[0]

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities, and whether a text is rejected."""
        z, share = self.measure(texts)
        p = softmax(z / self.temperature)
        return p, (p.max(axis=1) < self.limit) | (share < self.least_seen)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return self.judge(texts)[0]


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams of each text and their shares."""
    out = []
    for t in texts:
        buf, _ = _joined([t])
        ids = np.concatenate([i[ok] for i, ok in gram_ids(buf)])
        i, n = np.unique(ids, return_counts=True)
        out.append((i.astype(np.int64), n / max(1, n.sum())))
    return out


def _descend(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int, rate: float, batch: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, layer and bias. Steps are clipped: no text pulls its embeddings, and no batch the layer, by more than a unit."""
    rng = np.random.default_rng(seed)
    embed, layer, bias = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), rng.normal(0, 0.3, (DIMENSIONS, classes)), np.zeros(classes)
    share = np.bincount(y, minlength=classes)
    weight = np.minimum(len(y) / (classes * np.maximum(share, 1)), MOST_WEIGHT)[y]
    steps, total = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            pick = [i for i in order[k : k + batch].tolist() if len(bags[i][0])]
            if not pick:
                continue
            ids, part = np.concatenate([bags[i][0] for i in pick]), np.concatenate([bags[i][1] for i in pick])
            size = np.array([len(bags[i][0]) for i in pick])
            at = np.cumsum(size) - size
            hidden = np.add.reduceat(embed[ids] * part[:, None], at)
            p = softmax(hidden @ layer + bias)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= weight[pick][:, None] / len(pick)
            step = rate * (1 - steps / total)
            steps += 1
            pull, turn = p @ layer.T, hidden.T @ p
            pull /= np.maximum(1, np.linalg.norm(pull, axis=1, keepdims=True))
            turn /= max(1.0, float(np.linalg.norm(turn)))
            layer -= 0.1 * step * turn
            bias -= 0.01 * step * p.sum(axis=0)
            np.subtract.at(embed, ids, step * part[:, None] * np.repeat(pull, size, axis=0) * 10)
    return embed, layer, bias


def train(texts: list[str], labels: list[str], apart: list[bool], epochs: int = 8, rate: float = 6.0, batch: int = 16, seed: int = 11) -> Model:
    """Fit to the texts that are not apart; calibrate on those that are. A descent that ends in numbers that aren't finite, or beyond MOST_SCORE, is made again at a quarter of the rate."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels], np.int64)
    apart_ = np.array(apart, bool)
    if apart_.all() or not apart_.any():
        apart_[:] = False
    own = np.flatnonzero(~apart_)
    bags = _bags([texts[i] for i in own])
    seen = np.zeros(BUCKETS, bool)
    for i in own.tolist():
        *_, (ids, ok) = gram_ids(_joined([texts[i]])[0])
        seen[ids[ok]] = True
    while True:
        with np.errstate(all="ignore"):
            embed, layer, bias = _descend(bags, y[own], len(languages), epochs, rate, batch, seed)
            table = (embed @ layer).astype(np.float32)
        if np.isfinite(table).all() and np.isfinite(bias).all() and max(np.abs(table).max(), np.abs(bias).max()) < MOST_SCORE:
            break
        rate /= 4
    model = Model(languages, table, bias, seen)
    return calibrate(model, [t for t, a in zip(texts, apart_, strict=True) if a], y[apart_])


def calibrate(model: Model, texts: list[str], y: np.ndarray) -> Model:
    """The temperature of least cross-entropy, and the limits, from texts kept apart.

    Each limit is half of what all but one right answer in a thousand reach: of the probability (at most
    0.5), and of the share of n-grams known. So clean texts stay.
    """
    if not texts:
        return model
    z, share = model.measure(texts)

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    model.temperature = float(min(np.geomspace(0.01, 100, 161), key=loss))
    p = softmax(z / model.temperature)
    right = p.argmax(axis=1) == y
    if right.any():
        model.limit = float(min(0.5, np.quantile(p.max(axis=1)[right], 0.001) / 2))
        model.least_seen = float(np.quantile(share[right], 0.001) / 2)
    return model


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", held: tuple[int, int] = (5, 0)) -> Model | None:
    """Train on a bounded sample of the labelled rows that are not held out; None if there are none.

    Of each language about PER_LANGUAGE rows with the least hashes of their keys are taken, MOST_SAMPLE
    in all; a fifth of them, by another hash, calibrates. Rows with a null label or text, or a text
    without a letter, teach nothing; repeated rows count each; ties of the hash go by key, and rows alike
    in both by text, so the sample is the same in each run. A single language is learned as the only one.
    """
    modulus, remainder = held
    known = df.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{label}`").cast("string").alias("lang"), fold(key, modulus).alias("part"))
    known = known.where((F.col("part") != remainder) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    place = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 30))
    enough = F.lit(False)
    for lang, n in counts.items():
        enough = enough | ((F.col("lang") == lang) & (place < int((1 << 30) * min(1.0, PER_LANGUAGE / n))))
    rows = known.where(enough).withColumn("place", place).orderBy("place", "key", "text").limit(MOST_SAMPLE).select("key", "text", "lang", (F.pmod(F.xxhash64("key", F.lit(4)), F.lit(5)) == 0).alias("apart")).collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["key"] or "", r["text"]))
    if not rows:
        return None
    return train([r["text"] for r in rows], [r["lang"] for r in rows], [r["apart"] for r in rows])


_letter = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return bool(_letter.search(text)) and any(map(str.isalpha, text))


def predict(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", held: tuple[int, int] = (5, 0), keep: tuple[str, ...] = ()) -> DataFrame:
    """id, held_out, lang_pred, score (calibrated probability) and rejected, for each row's whole text, and the columns to keep.

    A text that is null or has no letter is `und` with score 0 and rejected, and so is every text if
    there is no model. rejected also marks texts whose score, or share of known n-grams, is below the
    model's limits. Of languages with one score the first by name counts. Texts of any length are read
    whole; repeated rows are judged each; an empty table gives an empty result. Kept columns come out as
    kept_<name>, so names can't clash. The model (a table of BUCKETS rows by the number of languages) is
    broadcast; it doesn't grow with the data.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    new = ("id", "held_out", "lang_pred", "score", "rejected")
    schema = T.StructType([*T._parse_datatype_string("id long, held_out boolean, lang_pred string, score double, rejected boolean").fields, *(T.StructField(f"kept_{c}", df.schema[c].dataType) for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for begin, end in slices(texts, BLOCK):
                own = texts[begin:end]
                langs, scores, out = ["und"] * len(own), [0.0] * len(own), [True] * len(own)
                full = [i for i, t in enumerate(own) if model and t and has_letter(t)]
                if full:
                    for i, row, odd in zip(full, *model.judge([own[i] for i in full]), strict=True):
                        k = int(row.argmax())
                        langs[i], scores[i], out[i] = model.languages[k], float(row[k]), bool(odd)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_()), *(batch.column(3 + k).slice(begin, end - begin) for k in range(len(keep)))], [*new, *(f"kept_{c}" for c in keep)])

    own = [F.col(f"`{key}`").cast("long").alias("id"), (fold(key, held[0]) == held[1]).alias("held_out"), F.col(f"`{text}`").cast("string").alias("text")]
    return df.select(*own, *(F.col(f"`{c}`").alias(f"kept_{c}") for c in keep)).mapInArrow(run, schema)
