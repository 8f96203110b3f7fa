"""Recovering the roles of raw transcripts by a hidden Markov model, and rendering them canonically.

A transcript is lines of text, some of which begin with a speaker marker ("User:", "[assistant]", a
bare dash, or nothing). The states are a role and whether the line begins a turn; a line's
observation is its marker's kind, its length, its ending and its first letter. Start, transition and
emission probabilities are counted on transcripts whose roles are known, and smoothed; Viterbi
finds the likeliest states of a transcript's lines, from which turns and roles follow.

A conversation of more than SEGMENT turns is several transcripts. Viterbi reads the last CONTEXT turns of
the transcript before and the first of the one after along with it, and drops them, so that roles at a
border are decided by what stands on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlane.llm.common import fold, kept_names

ROLES = ("system", "user", "assistant")
#: Names by which transcripts mark each role's speaker.
MARKERS = {"system": ("system", "sys", "instructions"), "user": ("user", "human", "customer", "q"), "assistant": ("assistant", "ai", "bot", "a")}
#: Ways to mark a turn; the last has no name, so the role must be found from its neighbours.
STYLES = ("{}: ", "[{}] ", "### {}\n", "<{}> ", "- ")
_KIND = {name: i + 1 for i, role in enumerate(ROLES) for name in MARKERS[role]}
NAMELESS, KINDS = len(ROLES) + 1, len(ROLES) + 2
_marker = re.compile(r"(?:\[(\w+)\]|<(\w+)>|### *(\w+)|(\w+) *:|(-)(?= ))\s*", re.IGNORECASE)
LENGTHS, ENDINGS, FIRSTS = 5, 4, 3
STATES = 2 * len(ROLES)  # role * 2 + (0: begins a turn, 1: goes on)
#: Turns of a conversation joined to one transcript, so that its length is bounded; and turns of its neighbours that are read along.
SEGMENT, CONTEXT = 512, 24


def split_marker(line: str) -> tuple[int, str]:
    """(kind of marker, rest of the line); kind 0: none, role + 1, or NAMELESS."""
    m = _marker.match(line)
    if not m:
        return 0, line
    name = next((g for g in m.groups()[:4] if g), "").lower()
    kind = NAMELESS if m[5] else _KIND.get(name, 0)
    return (kind, line[m.end() :]) if kind else (0, line)


def observe(line: str) -> tuple[int, int, int, int]:
    """Kind of marker, and classes of length, last character and first character."""
    kind, rest = split_marker(line)
    words = rest.count(" ") + 1 if rest else 0
    length = 0 if not words else min(LENGTHS - 1, 1 + (words > 4) + (words > 15) + (words > 40))
    end = "." in rest[-1:] and 1 or rest[-1:] in "?!" and 2 or 3
    return kind, length, end if rest else 0, 0 if not rest else 1 if rest[0].isupper() else 2


class Hmm:
    """Log-probabilities of starts, transitions and emissions."""

    def __init__(self, starts: np.ndarray, moves: np.ndarray, emissions: list[np.ndarray]):
        self.starts, self.moves, self.emissions = starts, moves, emissions

    def viterbi(self, observed: np.ndarray) -> np.ndarray:
        """Likeliest states of lines (n x 4 classes)."""
        log = sum(e[:, observed[:, k]] for k, e in enumerate(self.emissions)).T
        best, back = self.starts + log[0], np.zeros(log.shape, np.int8)
        for i in range(1, len(log)):
            way = best[:, None] + self.moves
            back[i] = way.argmax(axis=0)
            best = way.max(axis=0) + log[i]
        out = np.empty(len(log), np.int64)
        out[-1] = best.argmax()
        for i in range(len(log) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out


def _smooth(counts: np.ndarray, share: float = 0.01) -> np.ndarray:
    """Log-probabilities of rows of counts, each mixed with a share of all rows' own distribution.

    So what a state never showed is as unlikely for a rare state as for a common one.
    """
    whole = counts.reshape(-1, counts.shape[-1]).sum(axis=0) + 1.0
    total = counts.sum(axis=-1, keepdims=True)
    own = np.where(total > 0, counts / np.maximum(total, 1), whole / whole.sum())
    return np.log((1 - share) * own + share * whole / whole.sum())


def fit(labelled: DataFrame) -> Hmm:
    """From transcripts with known states: text, and states (array of a state for each line). Only sums reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, moves = np.zeros(STATES), np.zeros((STATES, STATES))
        emissions = [np.zeros((STATES, n)) for n in (KINDS, LENGTHS, ENDINGS, FIRSTS)]
        for batch in batches:
            for text, states in zip(batch["text"], batch["states"], strict=True):
                lines = text.split("\n")
                if not len(states) or len(states) != len(lines):
                    continue
                states = np.asarray(states, np.int64)
                starts[states[0]] += 1
                np.add.at(moves, (states[:-1], states[1:]), 1)
                for k, seen in enumerate(np.array([observe(x) for x in lines]).T):
                    np.add.at(emissions[k], (states, seen), 1)
        flat = np.concatenate([starts, moves.ravel(), *(e.ravel() for e in emissions)])
        yield pd.DataFrame({"i": np.flatnonzero(flat), "n": flat[flat > 0].astype(np.int64)})

    sums = labelled.select("text", "states").mapInPandas(count, "i int, n long").groupBy("i").agg(F.sum("n")).collect()
    sizes = [(STATES,), (STATES, STATES), *((STATES, n) for n in (KINDS, LENGTHS, ENDINGS, FIRSTS))]
    flat = np.zeros(sum(int(np.prod(s)) for s in sizes))
    for i, n in sums:
        flat[i] = n
    parts = [x.reshape(s) for x, s in zip(np.split(flat, np.cumsum([np.prod(s) for s in sizes])[:-1]), sizes, strict=True)]
    return Hmm(_smooth(parts[0]), _smooth(parts[1]), [_smooth(e) for e in parts[2:]])


def turns_of(text: str, model: Hmm, before: str = "", after: str = "") -> list[tuple[str, str]]:
    """(role, text) of each turn; markers are taken off the lines that begin a turn. before and after are read along."""
    lines = text.split("\n")
    ahead, behind = (x.split("\n") if x else [] for x in (before, after))
    states = model.viterbi(np.array([observe(x) for x in [*ahead, *lines, *behind]]))[len(ahead) : len(ahead) + len(lines)]
    out: list[tuple[str, list[str]]] = []
    for line, s in zip(lines, states.tolist(), strict=True):
        if s % 2 == 0 or not out or out[-1][0] != ROLES[s // 2]:
            out.append((ROLES[s // 2], [split_marker(line)[1]]))
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(body).strip("\n")) for role, body in out]


def render(turns: list[tuple[str, str]]) -> str:
    """Canonical form: each turn between <|role|> and <|end|> on lines of their own."""
    return "".join(f"<|{role}|>\n{body}\n<|end|>\n" for role, body in turns)


def parse(df: DataFrame, model: Hmm, text: str = "text", keep: tuple[str, ...] = ("id",), before: str | None = None, after: str | None = None) -> DataFrame:
    """The kept columns, roles and bodies (arrays, one entry for each turn) and rendered, of each transcript.

    before, after: columns of what stands ahead of and behind it. A null or blank transcript has no turns
    and an empty rendering; repeated rows are parsed each; of equally likely paths the first by states
    counts. A transcript of any length is parsed whole, in memory in proportion to it; an empty table
    gives an empty result. A kept column named like a result comes out as kept_<name>. No shuffle.
    """
    own = kept_names(keep, ("roles", "bodies", "rendered"))
    schema = T.StructType([*(T.StructField(n, df.schema[c].dataType) for c, n in zip(keep, own, strict=True)), *T._parse_datatype_string("roles array<string>, bodies array<string>, rendered string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (batch.column(len(keep) + k).to_pylist() for k in range(3))
            found = [turns_of(t, model, b or "", a or "") if t and t.strip() else [] for t, b, a in zip(*texts, strict=True)]
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array([[r for r, _ in x] for x in found], kind), pa.array([[b for _, b in x] for x in found], kind), pa.array([render(x) for x in found], pa.string())], [*own, "roles", "bodies", "rendered"])

    read = [F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string") for c in (text, before, after)]
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, own, strict=True)], *[c.alias(f"__{k}") for k, c in enumerate(read)]).mapInArrow(run, schema)


def transcripts(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Raw transcripts of conversations with their lines' true states: id, segment, piece, text, states, true_roles, before, after.

    Each conversation has one of the STYLES, by its key's hash; of every five turns about one loses its
    marker. SEGMENT consecutive turn numbers are joined, so a long conversation is several transcripts;
    before and after are the CONTEXT turns of its neighbours next to it. Where turn numbers repeat or are
    null, as in a conversation without a key, a segment may have more rows than that; they have no order
    then, and are dealt to pieces of about SEGMENT rows, so that none is gathered beyond a bound. A null
    role counts as user, a null text as empty, a null turn as the first; rows of one turn number go by
    role and text. Extra columns are not read. An empty table gives an empty result.
    """
    c = lambda n: F.col(f"`{n}`")
    who = F.coalesce(c(role).cast("string"), F.lit("user"))
    number = F.coalesce(c(turn).cast("long"), F.lit(0))
    name_of = F.crc32(F.coalesce(c(conv).cast("string"), F.lit("")))
    lost = F.crc32(F.concat_ws(":", c(conv).cast("string"), number.cast("string"))) % 5 == 0
    alias: Column = F.lit("user")
    for r, names in MARKERS.items():
        alias = F.when(who == r, F.element_at(F.array(*map(F.lit, names)), (name_of % len(names) + 1).cast("int"))).otherwise(alias)
    styled = F.lit("")
    for k, s in enumerate(STYLES):
        first, _, last = s.partition("{}")
        styled = F.when(name_of % len(STYLES) == k, F.concat(F.lit(first), alias, F.lit(last)) if "{}" in s else F.lit(s)).otherwise(styled)
    marked = F.concat(F.when(lost, F.lit("")).otherwise(styled), F.coalesce(c(text).cast("string"), F.lit("")))
    code = F.when(who == "system", 0).when(who == "assistant", 4).otherwise(2)
    lines = F.size(F.split("x.body", "\n", -1))
    segment = F.floor(number / SEGMENT).cast("long")
    rows = df.select(c(conv).alias("id"), segment.alias("segment"), F.struct(number.alias("turn"), who.alias("role"), marked.alias("body"), code.alias("code")).alias("x"))
    rows = rows.withColumn("states", F.transform(F.sequence(F.lit(1), lines), lambda k: F.col("x.code") + F.when(k > 1, 1).otherwise(0)))
    crowded = rows.groupBy("id", "segment").agg(F.count("*").alias("n")).where(F.col("n") > SEGMENT).select(F.col("id").alias("of"), F.col("segment").alias("at"), F.ceil(F.col("n") / SEGMENT).alias("pieces"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).join(crowded, F.col("id").eqNullSafe(F.col("of")) & (F.col("segment") == F.col("at")), "left")
    rows = rows.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("row"), F.col("pieces")), F.lit(0)).cast("int"))
    # A turn near a border stands in its own transcript (part 0) and behind (1) or ahead of (-1) the neighbour's.
    place = F.pmod("x.turn", F.lit(SEGMENT))
    alone = F.col("pieces").isNull()
    parts = F.array_compact(F.array(F.struct(F.lit(0).alias("part"), F.col("segment").alias("to")), F.when(alone & (place < CONTEXT), F.struct(F.lit(1).alias("part"), (F.col("segment") - 1).alias("to"))), F.when(alone & (place >= SEGMENT - CONTEXT), F.struct(F.lit(-1).alias("part"), (F.col("segment") + 1).alias("to")))))
    rows = rows.select("id", "piece", F.explode(parts).alias("p"), "x", "states").select("id", F.col("p.to").alias("segment"), "piece", F.struct(F.col("p.part").alias("part"), "x.turn", "x.role", "x.body", "states").alias("x"))
    joined = rows.groupBy("id", "segment", "piece").agg(F.array_sort(F.collect_list("x")).alias("x"))
    part = lambda k: F.filter("x", lambda e: e["part"] == k)
    text_of = lambda k: F.array_join(F.transform(part(k), lambda e: e["body"]), "\n")
    out = joined.where(F.exists("x", lambda e: e["part"] == 0))
    return out.select("id", "segment", "piece", text_of(0).alias("text"), F.flatten(F.transform(part(0), lambda e: e["states"])).alias("states"), F.transform(part(0), lambda e: e["role"]).alias("true_roles"), text_of(-1).alias("before"), text_of(1).alias("after"))


def training_rows(raw: DataFrame, held: tuple[int, int] = (5, 0)) -> DataFrame:
    """The transcripts whose key isn't held out; a null key counts as empty text."""
    return raw.where(fold("id", held[0]) != held[1])
