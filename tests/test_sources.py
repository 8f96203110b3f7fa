"""BAM round trips, ranges, FASTA, tables, locks and publishing; and the command line end to end."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from siftlane import cli, schema
from siftlane.sources import bam, fasta, files

HEADER = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr1\tLN:1000\n@CO\tkept\n"
COLUMNS = "qname string, flag int, ref_id int, pos bigint, mapq int, cigar string, mate_ref_id int, mate_pos bigint, tlen int, seq string, qual binary, nm bigint, " + f"aux {schema.AUX}"


def write(spark, path, rows, partitions=1):
    full = [(q, flag, ref, pos, 60, cigar, -1, -1, 0, seq, None, nm, None) for q, flag, ref, pos, cigar, seq, nm in rows]
    bam.write_bam(spark.createDataFrame(full, COLUMNS).coalesce(partitions), str(path), HEADER)
    return str(path)


def test_round_trip(spark, tmp_path):
    aux = [("NM", "i", None, 3, None, None, None), ("XA", "B", "C", None, None, None, [1.0, 2.0, 3.0]), ("XG", "Z", None, None, None, "CT", None), ("XF", "f", None, None, 0.5, None, None)]
    row = ("r", 1, 0, 10, 60, "5M", 0, 20, 7, "ACGTN", None, None, aux)
    path = str(tmp_path / "a.bam")
    bam.write_bam(spark.createDataFrame([row], COLUMNS), path, HEADER)
    got = bam.read_bam(spark, path).collect()[0]
    assert (got.qname, got.flag, got.pos, got.cigar, got.mate_pos, got.tlen, got.seq, got.nm, got.nm_type, got.xg, got.ref_name) == ("r", 1, 10, "5M", 20, 7, "ACGTN", 3, "int", "CT", "chr1")
    assert bytes(got.qual) == b"\xff" * 5 and [a.arr_val for a in got.aux][1] == [1.0, 2.0, 3.0]
    assert bam.header_of(path).text == HEADER
    refs = spark.read.format("bam").option("table", "references").load(path).collect()
    assert [(r.ref_id, r.ref_name, r.ref_len) for r in refs] == [(0, "chr1", 1000)]


def test_wrong_qualities(spark):
    with pytest.raises(ValueError):
        bam.encode_record({"qname": "r", "flag": 0, "seq": "ACGTN", "qual": b"ab"})


def test_ranges_hold_every_record_once(spark, tmp_path):
    rows = [(f"r{i:06d}", 0, 0, i * 20, "20M", "ACGTACGTACGTACGTACGT", i % 5) for i in range(40_000)]
    path = write(spark, tmp_path / "big.bam", rows, 4)
    assert bam.is_sorted(path) and bam.read_bam(spark, path).count() == len(rows)
    bam.build_bai(path)
    split = bam.read_bam(spark, path, rangeBytes="20000", fields="core")
    assert split.rdd.getNumPartitions() > 1
    assert split.select("qname").distinct().count() == split.count() == len(rows)


def test_files_without_an_index_are_read_in_parts(spark, tmp_path):
    """Records of all lengths, some longer than a block, some that look like the begin of others, in parts of any size."""
    import random

    r = random.Random(5)
    rows = [(f"name{i}", 16 * (i % 2), -1 if i % 9 == 0 else 0, i, f"{n}M", "".join(r.choice("ACGTN") for _ in range(n)), i % 7) for i, n in enumerate(r.choice([1, 5, 90, 151]) if k % 400 else 150_000 for k in range(3000))]
    path = write(spark, tmp_path / "u.bam", rows, 3)
    want = sorted((q, flag, pos, len(seq)) for q, flag, _, pos, _, seq, _ in rows)
    size = os.path.getsize(path)
    for part in (size // 3, size // 40, 5000):
        got = bam.read_bam(spark, path, rangeBytes=str(part))
        assert got.rdd.getNumPartitions() > 2
        assert sorted((x.qname, x.flag, x.pos, len(x.seq)) for x in got.collect()) == want
    first = [at for at, _ in bam.records_of(path)]
    assert bam.record_after(path, 0, 1) == first[0] and bam.record_after(path, size - 10, 1) is None
    with pytest.raises(ValueError, match="split=false"):
        list(bam.records_of(path, None, first[5] + 1))


def test_damaged_file(spark, tmp_path):
    path = write(spark, tmp_path / "d.bam", [("a", 0, 0, 1, "1M", "A", 0)])
    raw = bytearray(open(path, "rb").read())
    raw[30] ^= 0xFF
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match=r"damaged|invalid|Error"):
        bam.header_of(path)


def test_fasta_tiles_and_windows(spark, tmp_path):
    seq = "ACGTTGCACCGGATTA" * 40
    body = ">chr1 text\n" + "\n".join(seq[i : i + 60] for i in range(0, len(seq), 60)) + "\n>2\nACGT\n"
    plain, packed = tmp_path / "g.fa", tmp_path / "g.fa.gz"
    plain.write_text(body)
    packed.write_bytes(gzip.compress(body.encode()))
    for path in (plain, packed):
        tiles = fasta.read_fasta(spark, str(path), 64)
        assert {r.contig: r.length for r in fasta.contig_lengths(tiles).collect()} == {"chr1": len(seq), "2": 4}
        asked = spark.createDataFrame([(1, "chr1", 60, 10), (2, "1", 0, 200), (3, "chr2", 1, 3), (4, "chr1", len(seq) - 2, 3), (5, "chrX", 0, 1), (6, "chr1", -1, 3)], "id bigint, contig string, start bigint, length bigint")
        got = {r.id: r.window for r in fasta.fetch_windows(fasta.with_fallback(asked, tiles), tiles, 64).collect()}
        assert got == {1: seq[60:70], 2: seq[:200], 3: "CGT", 4: None, 5: None, 6: None}


def test_tables(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("fragment_id\tknown_source\tmore\na\thuman\t1\nb\tmouse\t2\n")
    assert files.read_truth(spark, str(p)).count() == 2
    for bad in ("fragment_id\tknown_source\na\thuman\na\tmouse\n", "fragment_id\tknown_source\na\trat\n", "fragment_id\tknown_source\n\thuman\n", "fragment_id\tknown_source\n", "x\ty\na\tb\n"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            files.read_truth(spark, str(p))
    n = tmp_path / "names"
    n.write_text("a\nb\na\n")
    assert sorted(r.qname for r in files.read_names(spark, str(n)).collect()) == ["a", "b"]
    for bad in ("a\n\nb\n", ""):
        n.write_text(bad)
        with pytest.raises(ValueError):
            files.read_names(spark, str(n))
    s = tmp_path / "x.sam"
    s.write_text("@HD\tVN:1\nr\t0\tchr1\t11\t60\t5M\t*\t0\t0\tACGTN\t*\tNM:i:2\tXG:Z:GA\nq\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\n")
    got = files.read_sam(spark, str(s)).orderBy("qname").collect()
    assert [(r.qname, r.pos, r.nm, r.xg) for r in got] == [("q", -1, None, None), ("r", 10, 2, "GA")]
    s.write_text("r\t0\n")
    with pytest.raises(Exception, match="fewer than 11"):
        files.read_sam(spark, str(s)).collect()
    import hashlib

    assert files.digest_check(spark, str(s), 4, hashlib.sha256(b"r\t0\n").hexdigest())
    assert not files.digest_check(spark, str(s), 5, hashlib.sha256(b"r\t0\n").hexdigest())


def test_lock_and_publish(tmp_path):
    place = str(tmp_path / "o.bam")
    with files.output_lock(place), pytest.raises(FileExistsError), files.output_lock(place):
        pass
    assert not os.path.exists(place + ".lock")
    for name, body in (("o.bam", "old"), ("o.bam.bai", "old"), ("s", "new"), ("s.bai", "new")):
        (tmp_path / name).write_text(body)

    def fails(a, b):
        if b.endswith(".bai"):
            raise OSError("no")
        os.replace(a, b)

    places = [place, place + ".bai"]
    with pytest.raises(OSError, match="no"):
        files.publish([str(tmp_path / "s"), str(tmp_path / "s.bai")], places, fails)
    assert [open(p).read() for p in places] == ["old", "old"]
    (tmp_path / "s").write_text("new")
    files.publish([str(tmp_path / "s"), str(tmp_path / "s.bai")], places)
    assert [open(p).read() for p in places] == ["new", "new"] and sorted(os.listdir(tmp_path)) == ["o.bam", "o.bam.bai"]


def test_command_line(spark, tmp_path, capsys):
    g = write(spark, tmp_path / "g.bam", [("two", 0, 0, 200, "4M", "ACGT", 0), ("one", 0, 0, 100, "4M", "ACGT", 1), ("lost", 0, 0, 5, "4M", "ACGT", 3)])
    h = write(spark, tmp_path / "h.bam", [("one", 0, 0, 7, "4M", "ACGT", 2), ("lost", 0, 0, 7, "4M", "ACGT", 0)])
    out = tmp_path / "out"
    assert cli.main(["run", "-g", g, "-t", h, "-o", str(out)]) == 0
    place = str(out / "g_Filtered.bam")
    assert [r.qname for r in bam.read_bam(spark, place).collect()] == ["one", "two"] and os.path.exists(place + ".bai")
    shown = capsys.readouterr().out
    assert "g.bam\t3\t1\t0\t2\t66.67%\t33.33%\t0.00%\t66.67%\t4\n" in shown and f"g.bam - Output: {place}" in shown
    assert not [n for n in os.listdir(out) if "selected" in n or "staged" in n]
    assert cli.main(["run", "-g", g, "-t", h, "-o", str(out), "--sort-memory", "4M"]) == 2
    fa = tmp_path / "r.fa"
    fa.write_text(">1\n" + "ACGT" * 250 + "\n")
    assert cli.main(["audit", "--bam", g, "--reference", str(fa), "--report", str(tmp_path / "audit")]) == 0
    got = files.read_table(spark, str(tmp_path / "audit"), schema.AUDIT).orderBy("record_ordinal").collect()
    assert [(r.qname, r.stored_nm, r.nm, r.classification_score) for r in got] == [("two", 0, 0, 0), ("one", 1, 0, 0), ("lost", 3, 4, 4)]


def test_recompute_mode(spark, tmp_path):
    fa = tmp_path / "r.fa"
    fa.write_text(">chr1\n" + "ACGT" * 250 + "\n")
    g = write(spark, tmp_path / "g.bam", [("a", 0, 0, 0, "4M", "ATGT", None), ("b", 0, 0, 4, "4M", "ACGT", None)])
    h = write(spark, tmp_path / "h.bam", [("a", 0, 0, 1, "4M", "ATGT", None), ("b", 0, 0, 0, "4M", "TTTT", None)])
    args = ["run", "-g", g, "-t", h, "-o", str(tmp_path / "o"), "--graft-ref", str(fa), "--host-ref", str(fa)]
    assert cli.main([*args, "--bisulfite"]) == 0
    assert sorted(r.qname for r in bam.read_bam(spark, str(tmp_path / "o/g_Filtered.bam")).collect()) == ["a", "b"]
    assert cli.main([*args[:-2], "--recalculate-nm"]) == 2
    assert F.col is not None
