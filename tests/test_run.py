"""Whole runs on small alignment files."""

from __future__ import annotations

import re
import struct

import pytest

from strandloom.config import Config
from strandloom.plans import run as runs
from strandloom.sources import bam

CONTIGS = [("chr1", 1000000), ("chr2", 1000000)]
HEAD = "@HD\tVN:1.6\tSO:coordinate\n@PG\tID:aligner\tPN:aligner\n"
BLOCKS = ("ACGA", "CGAC", "GACG", "ACGC")


def rx(blocks=BLOCKS, gaps=("TTT", "TT", "TT", "TT", "TTT")):
    return "".join(g + b for g, b in zip(gaps, (*blocks, ""), strict=True))


def record(name, tid, pos, cigar, tag=None, flag=0, strand="+", mapq=60, more=b""):
    ops = [int(n) << 4 | bam.OPS.index(c) for n, c in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    raw = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, mapq, 0, len(ops), flag, 0, -1, -1, 0) + name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops)
    raw += (b"RXZ" + tag.encode() + b"\0" if tag else b"") + (b"TSA" + strand.encode() if strand else b"") + more
    return struct.pack("<i", len(raw)) + raw


def write(path, records, head=HEAD):
    data = bam.head_bytes(head, CONTIGS) + b"".join(records)
    path.write_bytes(b"".join(bam._block(data[i : i + 1000]) for i in range(0, len(data), 1000)) + bam.EOF)
    return str(path)


CLEAN = rx()
RECORDS = [
    record("short", 0, 100, "3S200M", CLEAN), record("damaged", 0, 100, "3S250M", rx(("ACG", *BLOCKS[1:]))), record("no_rx", 0, 100, "3S300M"),
    record("long", 0, 101, "3S400M", CLEAN), record("drift", 0, 102, "3S300M", rx(gaps=("TT", "TT", "TT", "TT", "TTT"))),
    record("far1", 0, 20000, "3S300M", CLEAN), record("far2", 0, 20004, "3S310M", CLEAN), record("far3", 0, 25000, "3S300M", CLEAN),
    record("minus1", 0, 30000, "400M3S", CLEAN, 16), record("minus2", 0, 30200, "200M3S", CLEAN, 16), record("minus_other", 0, 30250, "100M3S", CLEAN, 16), record("minus3", 0, 30300, "100M3S", CLEAN, 16),
    record("sense", 0, 40000, "3S300M", CLEAN), record("antisense", 0, 40000, "300M3S", CLEAN, 16),
    record("chimera", 0, 45000, "70S300M", CLEAN, more=b"SAZx\0"), record("clipped", 0, 46000, "70S300M", CLEAN), record("fallback", 0, 47000, "3S300M", CLEAN, strand="?", more=b"tsA+"),
    record("none1", 1, 1000, "3S600M", CLEAN, strand=None), record("none2", 1, 1300, "3S600M", CLEAN, strand=None, flag=16),
    record("gene1", 1, 50000, "3S200M300N500M", CLEAN, more=b"ptC\x3e"), record("gene2", 1, 50001, "3S199M300N490M", CLEAN, more=b"ptC\x3a"),
    record("low", 1, 60000, "3S300M", CLEAN, mapq=0), record("unmapped", -1, -1, "3S10M", CLEAN, flag=4),
]
GTF = "".join(f'chr2\tx\t{kind}\t{lo}\t{hi}\t.\t+\t.\tgene_id "G1"; transcript_id "T1";\n' for kind, lo, hi in (("gene", 50001, 51000), ("exon", 50001, 50200), ("exon", 50501, 51000)))
SIZES = {"long": 4, "far2": 2, "far3": 1, "minus1": 3, "minus_other": 1, "sense": 1, "antisense": 1, "clipped": 1, "fallback": 1, "none1": 2, "gene1": 2}


def read(spark, path):
    """name -> (flag, tags) in the order of the file."""
    out = {}
    for r in bam.read_bam(spark, [path]).orderBy("ordinal").collect():
        raw = bytes(r.raw)
        at = 32 + raw[8] + 4 * struct.unpack_from("<H", raw, 12)[0]
        out[r.qname] = (r.flag, {n: v for n, _, v, _, _ in bam.tags(raw[at:])})
    return out


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    source = write(folder / "in.bam", RECORDS)
    (folder / "a.gtf").write_text(GTF)
    return folder, source


def test_filter(spark, files):
    folder, source = files
    found = runs.run(spark, [source], str(folder / "out.bam"), Config(), str(folder / "a.gtf"), str(folder / "stats.tsv"), str(folder / "molecules"), "x -i a")
    out = read(spark, str(folder / "out.bam"))
    assert {name: t["uS"] for name, (_, t) in out.items()} == SIZES and [t["MI"] for _, t in out.values()] == [str(i + 1) for i in range(len(SIZES))]
    first = out["long"][1]
    assert (first["uN"], first["uJ"], first["uD"], first["uA"], first["uF"]) == ("".join(BLOCKS), 4, 0, "?", "N") and not {"uP", "uT", "uG"} & set(first)
    gene = out["gene1"][1]
    assert (gene["uA"], gene["uP"], gene["uF"], gene["uT"], gene["uG"]) == ("Y", 60, "Y", "T1", "G1")
    report = dict(x.split("\t") for x in (folder / "stats.tsv").read_text().splitlines()[1:])
    assert report == found and len(report) == 44
    want = {"total_records": 23, "dropped_no_RX": 1, "dropped_chimeric_umi_end": 1, "dropped_low_mapq": 1, "dropped_unmapped": 1, "umi_block_damaged": 1, "damaged_to_valid": 1, "umi_anchor_repaired": 0, "strand_from_ts": 1, "strand_unknown": 2, "umi_position_splits": 1, "full_length_molecules": 1, "full_length_both_signals": 1, "records_written": 11, "molecules_out": 11}
    assert {k: report[k] for k in want} == {k: str(v) for k, v in want.items()}
    rows = [x.split("\t") for part in sorted((folder / "molecules").glob("part-*")) for x in part.read_text().splitlines() if not x.startswith("MI")]
    assert rows[0] == ["1", "chr1", "+", "101", "".join(BLOCKS), "N", "4", "4", "0", "long", "102", "501", "?", "0", "N", ".", "."]
    assert rows[-1] == ["11", "chr2", "+", "50001", "".join(BLOCKS), "N", "2", "1", "0", "gene1", "50001", "51000", "Y", "60", "Y", "T1", "G1"] or rows[-1][7] == "2"
    assert [r[2] for r in rows if r[9] == "none1"] == ["."]


def test_mark_twice_and_with_stricter_filters(spark, files):
    folder, source = files
    runs.run(spark, [source], str(folder / "marked.bam"), Config(mode="mark"))
    out = read(spark, str(folder / "marked.bam"))
    assert len(out) == len(RECORDS)
    for name, (flag, t) in out.items():
        if name in SIZES:
            assert not flag & 1024 and t["uS"] == SIZES[name] and "uJ" in t and "uF" not in t
        elif name in ("no_rx", "chimera", "low", "unmapped"):
            assert not flag & 1024 and "MI" not in t
        else:
            assert flag & 1024 and "MI" in t and "uJ" not in t
    runs.run(spark, [str(folder / "marked.bam")], str(folder / "again.bam"), Config(mode="mark"))
    assert read(spark, str(folder / "again.bam")) == out
    ids = [x.split("\t")[1:] for x in bam.header(str(folder / "again.bam"))[0].splitlines() if x.startswith("@PG")]
    assert [x[0] for x in ids] == ["ID:aligner", "ID:strandloom", "ID:strandloom.1"] and ids[2][2] == "PP:strandloom"
    # Nothing passes: the marks of the earlier run go.
    found = runs.run(spark, [str(folder / "marked.bam")], str(folder / "bare"), Config(mode="mark", min_qs=5.0))
    parts = sorted((folder / "bare").glob("*.bam"))
    assert found["molecules_out"] == "0" and found["dropped_low_qs"] == str(len(RECORDS) - 2)
    bare = {k: v for p in parts for k, v in read(spark, str(p)).items()}
    assert len(bare) == len(RECORDS) and not any(flag & 1024 or "MI" in t for flag, t in bare.values())


def test_unsorted_records_and_cut_files_are_refused(spark, tmp_path):
    reads = spark.createDataFrame([(i, 0, s) for i, s in enumerate((5, 9, 7))], "ordinal long, tid int, start long")
    for per in (1, 2, 100):
        with pytest.raises(ValueError, match="not coordinate-sorted"):
            runs.require_order(reads, per)
        runs.require_order(reads.filter("ordinal < 2"), per)
    path = tmp_path / "x.bam"
    path.write_bytes(b"short")
    with pytest.raises(ValueError, match="cut short"):
        bam.require_end(str(path))


def test_options():
    a = runs.arguments(["-i", "a.bam", "-o", "o.bam", "--mode", "mark", "--pos-tol", "7", "--no-full-length"])
    assert a.bam == ["a.bam"] and a.pos_tol == 7 and a.no_full_length and a.umi_dist == 2 and a.mode == "mark"
    assert Config(ignore_strand=True).positions is False
