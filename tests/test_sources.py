from __future__ import annotations

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from strandloom.sources import bam, gtf

CONTIGS = [("chr1", 1000000), ("chr2", 1000000)]
HEAD = "@HD\tVN:1.6\tSO:coordinate\n"


def record(name, tid, pos, flag, fields=b""):
    raw = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, 60, 0, 2, flag, 4, -1, -1, 0) + name.encode() + b"\0" + struct.pack("<2I", 3 << 4 | 4, 200 << 4) + b"\x11\x11" + b"\xff" * 4 + fields
    return struct.pack("<i", len(raw)) + raw


def write(path, records, head=HEAD):
    data = bam.head_bytes(head, CONTIGS) + b"".join(records)
    path.write_bytes(b"".join(bam._block(data[i : i + 100]) for i in range(0, len(data), 100)) + bam.EOF)
    return str(path)


def test_bam_round_trip(spark, tmp_path):
    fields = b"RXZTTTACGA\0" + b"tsi" + struct.pack("<i", 5) + b"TSA+" + b"qsf" + struct.pack("<f", 12.5) + b"ptC\x3e" + b"uSi" + struct.pack("<i", 9)
    path = write(tmp_path / "a.bam", [record("a", 0, 100, 0, fields), record("b", 1, 50, 16)])
    a, b = bam.read_bam(spark, [path]).orderBy("ordinal").collect()
    assert (a.qname, a.tid, a.pos, a.flag, a.mapq, a.rx, a.ts_dorado, a.ts_mm2, a.qs, a.pt, a.has_sa, a.had_stale) == ("a", 0, 100, 0, 60, "TTTACGA", "+", None, 12.5, 62, False, True)
    assert [(x.op, x.len) for x in a.cigar] == [("S", 3), ("M", 200)] and b.rx is None and b.flag == 16
    own = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(v).alias("value")) for n, t, v in (("MI", "Z", "1"), ("uN", "Z", "ACGT"), ("uS", "i", "3"))])
    table = bam.read_bam(spark, [path]).withColumn("tags", F.when(F.col("qname") == "b", own))
    files = [r.file for r in bam.write_bam(table, str(tmp_path / "out"), bam.with_program(HEAD, "x", "1", "c\td"), CONTIGS).orderBy("part").collect()]
    back = bam.read_bam(spark, files).orderBy("ordinal").collect()
    assert [r.qname for r in back] == ["a", "b"] and not back[0].had_stale and back[1].had_stale and back[0].rx == "TTTACGA"
    assert all(open(f, "rb").read().endswith(bam.EOF) for f in files)


def test_unsorted_header_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="not coordinate-sorted"):
        bam.read_bam(spark, [write(tmp_path / "u.bam", [], "@HD\tVN:1.6\tSO:unsorted\n")])


def test_program_lines_chain():
    once = bam.with_program(HEAD, "x", "1", "c")
    twice = bam.with_program(once, "x", "1", "c")
    assert "ID:x\t" in once and "ID:x.1\tPN:x\tPP:x\t" in twice


def test_gtf(spark, tmp_path):
    text = "#c\n\nchr1\ts\texon\t101\t300\t.\t+\t.\thavana_gene_id \"NO\"; gene_id \"G1\"; transcript_id \"T1\";\nchr9\ts\texon\t1\t2\t.\t+\t.\tgene_id \"G2\";\nchr1\ts\texon\t0\t5\t.\t+\t.\tgene_id \"G3\";\nchr1\ts\tCDS\t1\t5\t.\t+\t.\tgene_id \"G4\";\nbad line\n"
    path = tmp_path / "a.gtf.gz"
    path.write_bytes(gzip.compress(text.encode()))
    rows = gtf.read_gtf(spark, str(path), spark.createDataFrame([("chr1", 0)], "name string, tid int")).collect()
    assert [(r.tid, r.feature, r.start, r.end, r.strand, r.gene_id, r.tx_id) for r in rows] == [(0, "exon", 100, 300, "+", "G1", "T1")]


def test_bam_splits_meet(spark, tmp_path):
    rng = random.Random(5)
    plain = [record(f"r{i}", i % 2, i, 0, b"xxZ" + bytes(rng.choice(b"ACGT") for _ in range(rng.choice((0, 30, 700)))) + b"\0") for i in range(300)]
    # Whole records within a field of another one: what looks like a record must be followed by more of them.
    inner = b"xxBC" + struct.pack("<I", 9 * len(plain[0])) + plain[0] * 9
    nested = record("outer", 1, 400, 0, inner + b"ptC\x3e")
    records = [*plain[:150], nested, *plain[150:]]
    long_head = HEAD + "".join(f"@CO\t{'x' * 90} {i}\n" for i in range(40))
    path = write(tmp_path / "a.bam", records, long_head)
    size = (tmp_path / "a.bam").stat().st_size
    want = [r[4:] for r in records]
    for split in (0, 700, 5000, size):
        rows = bam.read_bam(spark, [path, path], split_bytes=split).select("ordinal", "raw").collect()
        assert len({r.ordinal for r in rows}) == len(rows)
        assert [bytes(r.raw) for r in sorted(rows, key=lambda r: r.ordinal)] == want * 2
    # Where they lead into the next record they cannot be told apart; then reading fails and loses nothing unseen.
    misled = write(tmp_path / "b.bam", [*plain[:150], record("outer", 1, 400, 0, inner), *plain[150:]])
    size = (tmp_path / "b.bam").stat().st_size
    with pytest.raises(ValueError, match="do not meet"):
        for start in range(0, size, 300):
            list(bam.records_of(misled, start, min(start + 300, size), size, 2))
    empty = write(tmp_path / "empty.bam", [])
    assert bam.read_bam(spark, [empty], split_bytes=50).count() == 0


@pytest.mark.parametrize("cut", [10, 100])
def test_bam_cut_short_is_an_error(tmp_path, cut):
    path = write(tmp_path / "a.bam", [record(f"r{i}", 0, i, 0) for i in range(50)])
    data = (tmp_path / "a.bam").read_bytes()[: -28 - cut]
    (tmp_path / "a.bam").write_bytes(data)
    with pytest.raises(ValueError, match="cut short"):
        list(bam.records_of(path, 0, len(data), len(data), 2))
