"""BAM files as tables: a data source that reads and writes them, and their indexes.

spark.read.format("bam").load(path) gives the records; option table=references gives the reference
dictionary; option fields=core leaves out sequences, qualities and tags other than NM and XG. A file
with a .bai beside it is read in ranges that begin at offsets of that index; without one by one task,
as nothing else tells where records begin. Each range numbers its records from the file's start only
if it is the first, so ordinal is null in split files unless option split=false.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from siftlane.schema import ALIGNMENTS, REFERENCES
from siftlane.sources.bgzf import EOF, Stream, block, block_after, read_blocks, write_blocks

#: Codes of operations and of bases.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_PAIRS = [a + b for a in BASES for b in BASES]
_BASE = {c: i for i, c in enumerate(BASES)} | {c.lower(): i for i, c in enumerate(BASES)}
_INTS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I"}
INT_TYPES = tuple(_INTS)


@dataclass
class Header:
    text: str
    references: list[tuple[str, int]]


def read_header(s: Stream) -> Header:
    if s.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    (n,) = struct.unpack("<i", s.read(4))
    text = s.read(n).split(b"\0", 1)[0].decode()
    refs = []
    for _ in range(struct.unpack("<i", s.read(4))[0]):
        (n,) = struct.unpack("<i", s.read(4))
        name = s.read(n)[:-1].decode()
        refs.append((name, struct.unpack("<i", s.read(4))[0]))
    return Header(text, refs)


def decode_aux(raw: bytes) -> list[tuple]:
    """(tag, type, array_type, int_val, dbl_val, str_val, arr_val) of each field."""
    out, at = [], 0
    while at + 3 <= len(raw):
        tag, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        row = [tag, kind, None, None, None, None, None]
        if kind == "A":
            row[5], at = chr(raw[at]), at + 1
        elif kind in _INTS:
            row[3] = struct.unpack_from("<" + _INTS[kind], raw, at)[0]
            at += struct.calcsize(_INTS[kind])
        elif kind in "fd":
            row[4] = struct.unpack_from("<" + kind, raw, at)[0]
            at += 4 if kind == "f" else 8
        elif kind in "ZH":
            end = raw.index(b"\0", at)
            row[5], at = raw[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<I", raw, at + 1)[0]
            form = f"<{n}{_INTS.get(sub, sub)}"
            row[2], row[6] = sub, [float(x) for x in struct.unpack_from(form, raw, at + 5)]
            at += 5 + struct.calcsize(form)
        else:
            raise ValueError(f"unknown type {kind!r} of tag {tag}")
        out.append(tuple(row))
    return out


def decode_record(raw: bytes, refs: list[tuple[str, int]], core: bool, tag: str = "NM") -> dict:
    ref, pos, name_len, mapq, _, n_ops, flag, n_bases, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHIiii", raw)
    at = 32
    name, at = raw[at : at + name_len - 1].decode(), at + name_len
    ops, at = struct.unpack_from(f"<{n_ops}I", raw, at), at + 4 * n_ops
    row = {"qname": name, "flag": flag, "ref_id": ref, "ref_name": refs[ref][0] if 0 <= ref < len(refs) else None, "pos": pos, "mapq": mapq, "cigar": "".join(f"{o >> 4}{OPS[o & 15]}" for o in ops) or "*", "mate_ref_id": mate, "mate_pos": mate_pos, "tlen": tlen}
    packed = raw[at : at + (n_bases + 1) // 2]
    at += len(packed)
    if not core:
        row["seq"], row["qual"] = "".join(map(_PAIRS.__getitem__, packed))[:n_bases], raw[at : at + n_bases]
    aux = decode_aux(raw[at + n_bases :])
    for f in aux:
        if f[0] == tag:
            row["nm"], row["nm_type"] = f[3], "int" if f[1] in INT_TYPES else f[1]
        elif f[0] == "XG" and f[1] == "Z":
            row["xg"] = f[5]
    if not core:
        row["aux"] = aux
    return row


def _aux(fields: list) -> bytes:
    out = []
    for tag, kind, sub, i, d, s, arr in ((f["tag"], f["type"], f["array_type"], f["int_val"], f["dbl_val"], f["str_val"], f["arr_val"]) for f in fields):
        head = tag.encode() + kind.encode()
        if kind == "A":
            out.append(head + s.encode()[:1])
        elif kind in _INTS:
            out.append(head + struct.pack("<" + _INTS[kind], i))
        elif kind in "fd":
            out.append(head + struct.pack("<" + kind, d))
        elif kind in "ZH":
            out.append(head + s.encode() + b"\0")
        else:
            values = arr if sub in "fd" else [int(x) for x in arr]
            out.append(head + sub.encode() + struct.pack(f"<I{len(values)}{_INTS.get(sub, sub)}", len(values), *values))
    return b"".join(out)


def reg2bin(begin: int, end: int) -> int:
    """The smallest bin of the index that holds [begin, end)."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return first + (begin >> shift)
    return 0


def parse_cigar(text: str | None) -> list[tuple[int, str]]:
    out, n = [], ""
    for c in text or "":
        if c.isdigit():
            n += c
        elif c != "*":
            out.append((int(n), c))
            n = ""
    return out


def encode_record(row) -> bytes:  # noqa: ANN001
    """A record's bytes with its length before them. Qualities of another length than the bases' are an error; none are 0xFF."""
    get = lambda k, default=None: default if k not in row or row[k] is None else row[k]
    name, seq, qual = row["qname"].encode() + b"\0", get("seq", ""), get("qual")
    if qual is None or (len(qual) == 0 and seq):
        qual = b"\xff" * len(seq)
    if len(qual) != len(seq):
        raise ValueError(f"{row['qname']}: {len(qual)} qualities for {len(seq)} bases")
    ops = parse_cigar(get("cigar"))
    codes = [_BASE.get(c, 15) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    pos, span = get("pos", -1), sum(n for n, o in ops if o in "MDN=X") or 1
    aux = [f.asDict() if hasattr(f, "asDict") else f for f in get("aux", [])]
    if not aux and get("nm") is not None:
        aux = [{"tag": "NM", "type": "i", "array_type": None, "int_val": row["nm"], "dbl_val": None, "str_val": None, "arr_val": None}]
    body = struct.pack("<iiBBHHHIiii", get("ref_id", -1), pos, len(name), get("mapq", 0), reg2bin(max(pos, 0), max(pos, 0) + span) if pos >= 0 else 4680, len(ops), row["flag"], len(seq), get("mate_ref_id", -1), get("mate_pos", -1), get("tlen", 0))
    body += name + struct.pack(f"<{len(ops)}I", *(n << 4 | OPS.index(o) for n, o in ops)) + packed + bytes(qual) + _aux(aux)
    return struct.pack("<i", len(body)) + body


def encode_header(text: str) -> bytes:
    """A header's bytes; its references are the @SQ lines."""
    refs = []
    for line in text.splitlines():
        if line.startswith("@SQ"):
            f = dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x)
            refs.append((f["SN"].encode() + b"\0", int(f["LN"])))
    raw = text.encode()
    return b"BAM\1" + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(refs)) + b"".join(struct.pack("<i", len(n)) + n + struct.pack("<i", size) for n, size in refs)


def header_of(path: str) -> Header:
    with open(path, "rb") as f:
        return read_header(Stream(f))


def records_of(path: str, start: int | None = None, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, bytes) of each record that begins in [start, end); from the first record without start. end must be a record's begin."""
    with open(path, "rb") as f:
        s = Stream(f, start or 0)
        if start is None:
            read_header(s)
        while end is None or s.tell() < end:
            at, head = s.tell(), s.read(4)
            if not head:
                break
            if len(head) < 4:
                raise ValueError(f"{path} ends inside a record")
            raw = s.read(size := struct.unpack("<i", head)[0])
            if len(raw) < size:
                raise ValueError(f"{path} ends inside a record")
            yield at, raw
        if end is not None and s.tell() != end:
            raise ValueError(f"{path}: no record begins at {end}; read it with split=false")


#: Bytes of data by which the begin of a record is told, and records that must follow one another there; more bytes where records are longer.
PROBE, CHAIN, LONG_PROBE = 1 << 19, 3, 1 << 24


def record_after(path: str, offset: int, references: int) -> int | None:
    """The virtual offset of the first record that begins in a block at or after a place in the file; None if there is none.

    Blocks are told by their own checksums, and a record by the chain of well-formed ones that begins
    with it. Whoever reads up to it finds out if it is none: see records_of.
    """
    with open(path, "rb") as f:
        begin = block_after(f, offset)
        if begin is None:
            return None
        for most in (PROBE, LONG_PROBE):
            data, ends, whole = bytearray(), [], True
            for at, own in read_blocks(f, begin):
                ends.append((len(data), at))
                data += own
                if len(data) >= most:
                    whole = False
                    break
            for i in range(len(data)):
                if _chained(data, i, references, whole):
                    first, place = max(x for x in ends if x[0] <= i)
                    return place << 16 | (i - first)
            if whole:
                return None
    raise ValueError(f"{path}: no record is found after {offset}; read it with split=false")


def _chained(data: bytearray, at: int, references: int, whole: bool) -> bool:
    """Whether well-formed records follow one another from a place on: CHAIN of them, or up to the end of the file."""
    for n in range(CHAIN):
        if at == len(data):
            return whole and n > 0
        if at + 36 > len(data):
            return False
        size, ref, pos, name_len, _, _, ops, _, bases, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
        fixed = 32 + name_len + 4 * ops + (bases + 1) // 2 + bases
        if not (-1 <= ref < references and -1 <= mate < references and pos >= -1 and mate_pos >= -1 and name_len > 0 and bases >= 0 and fixed <= size):
            return False
        end = at + 36 + name_len
        if end > len(data) or data[end - 1] or not all(32 < c < 127 for c in data[at + 36 : end - 1]):
            return False
        if end + 4 * ops <= len(data) and any(data[k] & 15 > 8 for k in range(end, end + 4 * ops, 4)):
            return False
        at += 4 + size
        if at > len(data):
            return False
    return True


def read_bai(path: str) -> list[int]:
    """The virtual offsets of records that an index names, in order."""
    raw = open(path, "rb").read()
    if raw[:4] != b"BAI\1":
        raise ValueError("not a BAI file")
    at, found = 8, set()
    for _ in range(struct.unpack_from("<i", raw, 4)[0]):
        (bins,), at = struct.unpack_from("<i", raw, at), at + 4
        for _ in range(bins):
            number, chunks = struct.unpack_from("<Ii", raw, at)
            at += 8
            if number != 37450:
                found.update(struct.unpack_from(f"<{2 * chunks}Q", raw, at)[::2])
            at += 16 * chunks
        (n,), at = struct.unpack_from("<i", raw, at), at + 4 + 0
        at += 8 * n
    return sorted(found)


def build_bai(path: str) -> str:
    """Write the index of a file in coordinate order beside it."""
    header = header_of(path)
    bins: list[dict[int, list[list[int]]]] = [{} for _ in header.references]
    linear: list[dict[int, int]] = [{} for _ in header.references]
    last, unplaced = (0, -1), 0
    prior: tuple | None = None

    def note(entry: tuple, end: int) -> None:
        ref, b, begin, first, final = entry
        chunks = bins[ref].setdefault(b, [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = end
        else:
            chunks.append([begin, end])
        for w in range(first >> 14, (final >> 14) + 1):
            linear[ref].setdefault(w, begin)

    for at, raw in records_of(path):
        if prior:
            note(prior, at)
            prior = None
        ref, pos = struct.unpack_from("<ii", raw)
        if ref < 0:
            unplaced += 1
            continue
        if (ref, pos) < last:
            raise ValueError(f"{path} is not in coordinate order")
        last = (ref, pos)
        n_ops, name_len = struct.unpack_from("<H", raw, 12)[0], raw[8]
        span = sum(o >> 4 for o in struct.unpack_from(f"<{n_ops}I", raw, 32 + name_len) if OPS[o & 15] in "MDN=X") or 1
        prior = (ref, reg2bin(pos, pos + span), at, pos, pos + span - 1)
    if prior:
        note(prior, os.path.getsize(path) << 16)
    out = [b"BAI\1", struct.pack("<i", len(bins))]
    for own, lines in zip(bins, linear, strict=True):
        out.append(struct.pack("<i", len(own)))
        for number, chunks in sorted(own.items()):
            out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
        n = max(lines, default=-1) + 1
        at = 0
        offsets = [at := lines.get(w, at) for w in range(n)]
        out.append(struct.pack(f"<i{n}Q", n, *offsets))
    out.append(struct.pack("<Q", unplaced))
    with open(path + ".bai", "wb") as f:
        f.write(b"".join(out))
    return path + ".bai"


def is_sorted(path: str) -> bool:
    """Whether a file is in coordinate order; records without a place come last."""
    last = (0, -1)
    for _, raw in records_of(path):
        ref, pos = struct.unpack_from("<ii", raw)
        here = (ref if ref >= 0 else 1 << 40, pos)
        if here < last:
            return False
        last = here
    return True


class _Range(InputPartition):
    def __init__(self, path: str, start: int | None, end: int | None, whole: bool, raw: bool = False):
        """start and end: virtual offsets of records, or if raw places in the file."""
        self.path, self.start, self.end, self.whole, self.raw = path, start, end, whole, raw


class _Reader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns
        path = options["path"]
        self.paths = sorted(glob.glob(os.path.join(path, "*.bam"))) if os.path.isdir(path) else sorted(glob.glob(path)) or [path]
        self.core, self.table = options.get("fields", "all") == "core", options.get("table", "records")

    def partitions(self) -> list[_Range]:
        """Ranges by the index, of about rangebytes; without an index, by places in the file, whose records the tasks find."""
        out = []
        for p in self.paths:
            size = int(self.options.get("rangebytes", 64 << 20))
            if self.table != "records" or self.options.get("split", "true") == "false":
                out.append(_Range(p, None, None, True))
                continue
            if not os.path.exists(p + ".bai"):
                edges = [None, *range(size, os.path.getsize(p), size), None]
                out += [_Range(p, a, b, len(edges) == 2, True) for a, b in zip(edges, edges[1:], strict=False)]
                continue
            cuts: list[int] = []
            for offset in read_bai(p + ".bai"):
                if offset >> 16 >= (cuts[-1] >> 16 if cuts else 0) + size:
                    cuts.append(offset)
            edges = [None, *cuts, None]
            out += [_Range(p, a, b, not cuts) for a, b in zip(edges, edges[1:], strict=False)]
        return out

    def read(self, part: _Range) -> Iterator[tuple]:
        refs = header_of(part.path).references
        base = {"sample_id": self.options.get("sampleid", os.path.basename(part.path).removesuffix(".bam")), "side": self.options.get("side", "graft")}
        if self.table != "records":
            for i, (name, size) in enumerate(refs):
                row = base | {"ref_id": i, "ref_name": name, "ref_len": size}
                yield tuple(row[c] for c in self.columns)
            return
        tag, start, end = self.options.get("nmtag", "NM"), part.start, part.end
        if part.raw:
            start, end = (None if x is None else record_after(part.path, x, len(refs)) for x in (start, end))
            if part.start is not None and start is None:
                return  # no record begins so far on
        for n, (_, raw) in enumerate(records_of(part.path, start, end)):
            row = base | decode_record(raw, refs, self.core, tag)
            row["ordinal"] = n if start is None else None
            yield tuple(row.get(c) for c in self.columns)


@dataclass
class _Part(WriterCommitMessage):
    number: int
    path: str


class _Writer(DataSourceWriter):
    """Each task writes a part; the driver joins header, parts in order of their partitions, and the end."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.header, self.overwrite = options["path"], options.get("header", "@HD\tVN:1.6\n"), overwrite
        self.stem = f"{self.path}.{uuid.uuid4().hex}"

    def write(self, rows) -> _Part:  # noqa: ANN001
        from pyspark import TaskContext

        context = TaskContext.get()
        part = f"{self.stem}.{context.partitionId()}.{context.taskAttemptId()}"
        with open(part, "wb") as f:
            write_blocks(f, (encode_record(r.asDict()) for r in rows))
        return _Part(context.partitionId(), part)

    def commit(self, parts: list) -> None:
        if os.path.exists(self.path) and not self.overwrite:
            self.abort(parts)
            raise FileExistsError(self.path)
        with open(self.stem, "wb") as out:
            write_blocks(out, iter([encode_header(self.header)]))
            for p in sorted((p for p in parts if p), key=lambda p: p.number):
                with open(p.path, "rb") as f:
                    while chunk := f.read(1 << 20):
                        out.write(chunk)
            out.write(EOF)
        os.replace(self.stem, self.path)
        self.abort(parts)

    def abort(self, parts: list) -> None:
        for p in parts:
            if p and os.path.exists(p.path):
                os.remove(p.path)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return REFERENCES if self.options.get("table") == "references" else ALIGNMENTS

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(dict(self.options), schema.names)

    def writer(self, schema, overwrite: bool) -> _Writer:  # noqa: ANN001
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def read_bam(spark: SparkSession, path: str, side: str = "graft", **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("bam").options(side=side, **options).load(path)


def write_bam(df: DataFrame, path: str, header: str) -> None:
    """Write records in the order of their partitions. The folder must be shared by all executors."""
    register(df.sparkSession)
    df.write.format("bam").option("header", header).mode("append").save(path)


__all__ = ["BamSource", "block", "build_bai", "header_of", "is_sorted", "read_bam", "register", "write_bam"]
