"""Scores of records: CIGAR arithmetic, reference spans, validation, edit distances."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRED, UNMAPPED, REVERSE, FIRST, SECOND, SECONDARY, SUPPLEMENTARY = 0x1, 0x4, 0x10, 0x40, 0x80, 0x100, 0x800


def primary_mapped(flag: str = "flag", ref_id: str | None = "ref_id") -> Column:
    """Mapped, and neither secondary nor supplementary; quality and duplicate bits don't matter."""
    ok = F.col(flag).bitwiseAND(UNMAPPED | SECONDARY | SUPPLEMENTARY) == 0
    return ok & (F.col(ref_id) >= 0) if ref_id else ok


def mapped(flag: str = "flag", ref_id: str = "ref_id") -> Column:
    """Mapped; secondary and supplementary records too."""
    return (F.col(flag).bitwiseAND(UNMAPPED) == 0) & (F.col(ref_id) >= 0)


def is_first(flag: str = "flag") -> Column:
    return F.col(flag).bitwiseAND(FIRST | SECOND) == FIRST


def is_second(flag: str = "flag") -> Column:
    return F.col(flag).bitwiseAND(FIRST | SECOND) == SECOND


def op_sum(cigar: Column | str, ops: str) -> Column:
    """The summed lengths of the CIGAR operations in ops."""
    c = F.col(cigar) if isinstance(cigar, str) else cigar
    lengths = F.regexp_extract_all(c, F.lit(f"([0-9]+)[{ops}]"), F.lit(1))
    return F.aggregate(F.transform(lengths, lambda x: x.cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def insertions(cigar: str = "cigar") -> Column:
    return op_sum(cigar, "I")


def soft_clips(cigar: str = "cigar") -> Column:
    return op_sum(cigar, "S")


def reference_span(cigar: str = "cigar") -> Column:
    """Bases of the reference that the record covers, skips and deletions included."""
    return op_sum(cigar, "MDN=X")


def read_span(cigar: str = "cigar") -> Column:
    return op_sum(cigar, "MIS=X")


def parsed_cigar(cigar: str = "cigar") -> Column:
    """Array of struct<op, len>; empty for '*', blank or null."""
    found = F.regexp_extract_all(F.coalesce(F.col(cigar), F.lit("")), F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.regexp_extract(x, "[0-9]+", 0).cast("bigint").alias("len")))


def cigar_text(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")


def plain_score(nm: str = "nm", cigar: str = "cigar") -> Column:
    return F.col(nm) + insertions(cigar) + soft_clips(cigar)


def tag_error(nm: str = "nm", nm_type: str = "nm_type") -> Column:
    """missing_nm, non_integer_nm, or null."""
    return F.when(F.col(nm_type).isNull() & F.col(nm).isNull(), "missing_nm").when(F.coalesce(F.col(nm_type), F.lit("int")) != "int", "non_integer_nm")


def conversion(xg: str = "xg", flag: str = "flag") -> Column:
    """CT or GA: the XG tag decides; without a known one, the strand."""
    return F.when(F.col(xg).isin("CT", "GA"), F.col(xg)).otherwise(F.when(F.col(flag).bitwiseAND(REVERSE) != 0, "GA").otherwise("CT"))


UPPER = np.array([ord(chr(i).upper()) if i < 128 else i for i in range(256)], np.uint8)
BASES_AT_ONCE = 1 << 22


def _bases(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bases in upper case, one after another, and where each begins (and the last ends); null as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    held = column.buffers()[2]
    raw = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held else np.zeros(0, np.uint8)
    if not len(raw) or raw.max() < 128:
        return UPPER[raw], at - at[0]
    texts = [t.upper().encode("utf-32-le") for t in column.to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint32), np.cumsum([0, *(len(t) // 4 for t in texts)])


@lru_cache(1 << 14)
def _matched(cigar: str) -> tuple[tuple[tuple[int, int, int], ...], int]:
    """Runs of M, = and X as (place in the read, in the reference, length), and the inserted and deleted bases."""
    runs, read, ref, gaps = [], 0, 0, 0
    for length, op in re.findall("([0-9]+)([MIDNSHP=X])", cigar):
        n = int(length)
        if op in "M=X":
            runs.append((read, ref, n))
        read += n * (op in "M=XIS")
        ref += n * (op in "M=XDN")
        gaps += n * (op in "ID")
    return tuple(runs), gaps


def _runs(cigars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of the rows' CIGARs as (row, place in the read, in the reference, length), how many the rows before have, and each row's gaps. Each text is read once."""
    if pa.types.is_list(cigars.type) or pa.types.is_large_list(cigars.type):
        cigars = pa.array(["".join(f"{o['len']}{o['op']}" for o in ops or ()) for ops in cigars.to_pylist()], pa.string())
    coded = pc.fill_null(cigars, "").dictionary_encode()
    found = [_matched(c) for c in coded.dictionary.to_pylist()]
    table = np.array([r for runs, _ in found for r in runs], np.int64).reshape(-1, 3)
    size, gaps = np.array([len(runs) for runs, _ in found], np.int64), np.array([g for _, g in found], np.int64)
    of = coded.indices.to_numpy(zero_copy_only=False)
    many = size[of]
    before = np.cumsum(many) - many
    at = np.repeat((np.cumsum(size) - size)[of] - before, many) + np.arange(many.sum())
    return np.column_stack([np.repeat(np.arange(len(of)), many), table[at]]), np.append(before, many.sum()), gaps[of]


def _distances(seq: pa.Array, window: pa.Array, cigar: pa.Array, to: pa.Array) -> pa.Array:
    (s, s_at), (w, w_at) = _bases(seq), _bases(window)
    runs, before, plain = _runs(cigar)
    row, read, ref, n = runs.T
    there = np.maximum(np.minimum(n, np.minimum(np.diff(s_at)[row] - read, np.diff(w_at)[row] - ref)), 0)
    np.add.at(plain, row[there < n], (n - there)[there < n])  # beyond an end: no base to match
    free = plain.copy()
    read, ref = read + s_at[row], ref + w_at[row]
    ct, ga = (pc.fill_null(pc.equal(to, k), False).to_numpy(zero_copy_only=False) for k in ("CT", "GA"))
    total = np.append(0, np.cumsum(there))
    i = 0
    while i < len(row):
        j = max(i + 1, int(np.searchsorted(total, total[i] + BASES_AT_ONCE, "right")) - 1)
        size, own = there[i:j], row[i:j]
        begin = total[i:j] - total[i]
        each = np.arange(total[j] - total[i])
        x, y = s[np.repeat(read[i:j] - begin, size) + each], w[np.repeat(ref[i:j] - begin, size) + each]
        bad = np.flatnonzero(x != y)
        at = own[np.searchsorted(total[i + 1 : j + 1] - total[i], bad, "right")]
        x, y = x[bad], y[bad]
        kept = ~((ct[at] & (y == ord("C")) & (x == ord("T"))) | (ga[at] & (y == ord("G")) & (x == ord("A"))))
        plain += np.bincount(at, minlength=len(plain))
        free += np.bincount(at[kept], minlength=len(free))
        i = j
    return pa.StructArray.from_arrays([pa.array(plain, pa.int64()), pa.array(free, pa.int64())], ["plain", "free"])


def edit_distances(seq: str | Column, window: str | Column, cigar: str | Column, converted: Column | None = None) -> Column:
    """plain and free: a read's NM against the reference window that begins at its position, and the one without the conversions of bisulfite.

    Mismatches under M, = and X, inserted and deleted bases; skips don't count. Bases match if equal
    without regard to case; N and other codes match only themselves; beyond the end of either nothing
    matches. converted: CT or GA; a C of the reference read as T, or a G read as A, is then no mismatch in free.
    cigar: its text, or its parsed operations. A batch's bases are compared at once, in bounded pieces.
    """
    return F.arrow_udf(_distances, "struct<plain: bigint, free: bigint>")(seq, window, cigar, F.lit(None).cast("string") if converted is None else converted)


def edit_distance(seq: str | Column, window: str | Column, cigar: str | Column, converted: Column | None = None) -> Column:
    """The one of edit_distances that is asked for: free if conversions are told."""
    return edit_distances(seq, window, cigar, converted)["plain" if converted is None else "free"]


FACTS = pa.struct({"error": pa.string(), "span": pa.int64(), "used": pa.int64(), "insertions": pa.int64(), "soft_clips": pa.int64()})


@lru_cache(1 << 14)
def _facts_of(cigar: str) -> dict:
    """What a CIGAR tells without its read."""
    ops = [(op, int(n)) for n, op in re.findall("([0-9]+)([MIDNSHP=X])", cigar)]
    total = lambda kinds: sum(n for op, n in ops if op in kinds)
    if cigar in ("*", ""):
        error = "empty_cigar"
    elif not re.fullmatch("([0-9]+[A-Z=])+", cigar):
        error = "invalid_cigar"
    elif not re.fullmatch("([0-9]+[MIDNSHP=X])+", cigar):
        error = "unsupported_operation"
    elif any(n <= 0 for _, n in ops):
        error = "invalid_length"
    else:
        error = None if total("M=XDN") else "no_reference_bases"
    return {"error": error, "span": total("M=XDN"), "used": total("M=XIS"), "insertions": total("I"), "soft_clips": total("S")}


NO_CIGAR = _facts_of("*") | {"insertions": None, "soft_clips": None}


def _facts(cigar: pa.Array) -> pa.Array:
    coded = cigar.dictionary_encode()
    each = pa.array([*map(_facts_of, coded.dictionary.to_pylist()), NO_CIGAR], FACTS)
    return each.take(pc.fill_null(coded.indices, len(each) - 1))


def cigar_facts(cigar: str | Column = "cigar") -> Column:
    """error of the CIGAR or null, span of the reference, used bases of the read, insertions and soft_clips (null without a CIGAR): each text of a batch is read once."""
    return F.arrow_udf(_facts, "struct<error: string, span: bigint, used: bigint, insertions: bigint, soft_clips: bigint>")(cigar)


def reference_error(seq: str = "seq", window: str = "window", cigar: str = "cigar", pos: str = "pos", flag: str = "flag", ref_id: str = "ref_id", facts: Column | None = None) -> Column:
    """Why a record's distance can't be computed, or null; the first reason that holds. facts: the CIGAR's, where they are there."""
    facts, length = cigar_facts(cigar) if facts is None else facts, F.length(F.coalesce(F.col(seq), F.lit("")))
    span, used = facts["span"], facts["used"]
    return (
        F.when(facts["error"].isNotNull(), facts["error"])
        .when(F.col(window).isNull(), "reference_not_found")
        .when((F.col(ref_id) < 0) | (F.col(flag).bitwiseAND(UNMAPPED) != 0), "unmapped")
        .when(F.col(pos) < 0, "negative_position")
        .when(length == 0, "empty_sequence")
        .when(used > length, "beyond_read")
        .when(span > F.length(window), "beyond_reference")
        .when(used != length, "unused_bases")
    )


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null if b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))
