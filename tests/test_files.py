"""Files that many tasks read and write: blocked gzip, indexes, alignments, matrices."""

import gzip
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from allelix.operators import depth
from allelix.sources import bam, bgzf, files, mtx, tabix, vcf


def lines_of(spark, path, split):
    return [r[0] for r in files.blocked_lines(spark, path, split).collect()]


@pytest.mark.parametrize("name", ["a.txt", "a.txt.gz"])
def test_lines_round_trip_in_order(spark, tmp_path, name):
    rows = [(i, f"line {i} é" + "x" * (i % 50)) for i in range(20_000)] + [(20_000, "y" * 300_000), (20_001, ""), (20_002, "z")]
    df = spark.createDataFrame(rows, "_ord long, line string").repartition(9, "line")
    path = str(tmp_path / name)
    files.write_lines(df, path, ["# head", "#"], gzip=name.endswith(".gz"))
    want = ["# head", "#", *(x for _, x in rows)]
    assert (gzip.open if name.endswith(".gz") else open)(path, "rt", encoding="utf-8").read().split("\n")[:-1] == want
    assert sorted(os.listdir(tmp_path)) == [f".{name}.crc", name] or os.listdir(tmp_path) == [name]
    assert [r.value for r in files.numbered_lines(spark, path).orderBy("_ord").collect()] == want
    if name.endswith(".gz"):
        assert files.is_blocked(spark, path)
        for split in (1 << 14, 50_000, 1 << 25):
            assert lines_of(spark, path, split) == want


def test_files_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "_ord long, line string")
    files.write_lines(none, str(tmp_path / "a"))
    files.write_lines(none, str(tmp_path / "b.gz"), ["only"], gzip=True)
    assert (tmp_path / "a").read_bytes() == b"" and gzip.open(tmp_path / "b.gz").read() == b"only\n"
    assert lines_of(spark, str(tmp_path / "b.gz"), 10) == ["only"]


def test_parts_are_formatted_by_many_tasks(spark, tmp_path, monkeypatch):
    """No task but the ones that copy parts to their place handles more than its share."""
    seen = []
    real = files._join
    monkeypatch.setattr(files, "_join", lambda s, folder, parts, target: (seen.extend(parts), real(s, folder, parts, target)))
    files.write_lines(spark.range(400_000).select(F.col("id").alias("_ord"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("line")), str(tmp_path / "a"))
    sizes = [n for name, n in seen if name != "head"]
    assert len(sizes) >= 4 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_blocks():
    rng = random.Random(1)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 1000, bgzf.MOST)]
    for t in texts:
        b = bgzf.block(t)
        assert gzip.decompress(b) == t and bgzf.size_at(b) == len(b) <= bgzf.WIDEST
    assert bgzf.END == bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
    assert bgzf.size_at(gzip.compress(b"x")) == 0


def test_damaged_blocks_are_errors(tmp_path):
    data = bytearray(bgzf.block(b"hello" * 100) + bgzf.END)
    data[-50] ^= 1
    (tmp_path / "x").write_bytes(data)
    with open(tmp_path / "x", "rb") as f, pytest.raises((ValueError, zlib.error)):
        bgzf.Blocks(f, len(data)).text(0)


# ---------------------------------------------------------------- indexed variants


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    k, path = F.col("id"), str(tmp_path_factory.mktemp("vcf") / "v.vcf.gz")
    text = lambda x: F.lit(x)
    rows = spark.range(60_000).select((k % 5).cast("string").alias("CHROM"), (k * 137 % 4_000_000).cast("int").alias("POS"), text(".").alias("ID"), F.when(k % 500 == 0, F.repeat(text("A"), 20_000)).otherwise("A").alias("REF"), text("G").alias("ALT"), text("1").alias("QUAL"), text("PASS").alias("FILTER"), F.sha2(k.cast("string"), 256).alias("INFO"))
    vcf.write_vcf(vcf.VcfData(["##x"], [], rows), path, index=True)
    return path, rows


@pytest.mark.parametrize("regions", [[("3", 100_000, 120_000)], [("1", 0, 5), ("4", 3_999_000, 5_000_000), ("0", 2_000_000, 2_000_000)], [("9", 1, 10)], [("2", 1, 9_000_000)], [("2", 16_384, 16_385), ("2", 16_385, 40_000)]])
def test_regions_of_indexed_variants(spark, indexed, regions):
    path, rows = indexed
    cond = " or ".join(f"(CHROM = '{c}' and POS <= {z} and POS + length(REF) - 1 >= {a})" for c, a, z in regions)
    want = sorted(map(tuple, rows.filter(cond).select("CHROM", "POS", "INFO").collect()))
    data = vcf.read_vcf_regions(spark, path, regions)
    assert sorted(map(tuple, data.variants.select("CHROM", "POS", "INFO").collect())) == want and data.header == ["##x"]
    index = tabix.read_index(spark, path)
    for split in (1 << 17, 1 << 25):
        ranges = tabix.ranges_of(index, regions, split)
        got = files.blocked_lines_between(spark, path, ranges)
        assert got.count() == got.distinct().count() >= len(want)
    if "9_000_000" not in str(regions) and regions[0][2] != 9_000_000:
        assert tabix.bytes_of(ranges) < os.path.getsize(path) / 4  # fewer bytes than the file has


def test_bed_of_indexed_variants(spark, indexed, tmp_path):
    path, rows = indexed
    (tmp_path / "r.bed").write_text("1\t1000\t2000\n1\t16383\t16384\n3\t0\t50000\n7\t1\t2\n")
    vcf.filter_vcf_by_bed(spark, path, str(tmp_path / "r.bed"), str(tmp_path / "o.vcf.gz"), gzip=True)
    want = rows.filter("CHROM = '1' and (POS <= 2000 and POS + length(REF) - 1 > 1000 or POS <= 16384 and POS + length(REF) - 1 > 16383) or CHROM = '3' and POS <= 50000 and POS + length(REF) - 1 > 0")
    got = vcf.read_vcf(spark, str(tmp_path / "o.vcf.gz")).variants
    assert sorted(r.INFO for r in got.collect()) == sorted(r.INFO for r in want.collect())


def test_bins():
    assert tabix.bin_of(0, 0) == 4681 and tabix.bin_of(16_383, 16_384) == 585 and tabix.bin_of(0, (1 << 29) - 1) == 0
    rng = random.Random(2)
    for _ in range(500):
        a, b = sorted(rng.randrange(1 << 22) for _ in range(2))
        c, d = sorted(rng.randrange(1 << 22) for _ in range(2))
        if a <= d and c <= b:
            assert tabix.bin_of(a, b) in tabix.bins_of(c, d)


def test_files_without_column_names(spark, tmp_path):
    (tmp_path / "x.vcf").write_text("##a\n")
    with pytest.raises(ValueError, match="column names"):
        vcf.read_vcf(spark, str(tmp_path / "x.vcf"))


# ---------------------------------------------------------------- alignments

CIGARS = ["10M5D10M", "30M", "5S20M3I4M", "10M100N10M", "7=2X1M", "4H9M", ""]


@pytest.fixture(scope="module")
def alignments(spark, tmp_path_factory):
    rng, path = random.Random(1), str(tmp_path_factory.mktemp("bam") / "a.bam")
    rows = [(f"r{i}", rng.choice([0, 16, 0, 0, 1024, 4]), rng.choice(["c1", "c2", "c10"]), rng.randrange(1, 250_000), rng.randrange(60), rng.choice(CIGARS)) for i in range(20_000)]
    rows += [(f"u{i}", 4, None, 0, 0, "") for i in range(50)]
    df = spark.createDataFrame(rows, "name string, flag int, chrom string, pos int, mapq int, text string").withColumn("cigar", bam.packed_cigar(F.col("text")))
    bam.write_bam(df.repartition(5), [("c1", 300_000), ("c2", 300_000), ("c10", 300_000)], path)
    return path, rows


@pytest.mark.parametrize("split", [32 << 20, 100_000, 66_000])
def test_alignments_round_trip(spark, alignments, split):
    path, rows = alignments
    data = bam.read_bam(spark, path, split)
    got = data.alignments.withColumn("text", bam.cigar_text(F.col("cigar"))).select("name", "flag", "chrom", "pos", "mapq", "text")
    assert got.rdd.getNumPartitions() == -(-os.path.getsize(path) // split)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((*r[:5], r[5] or "*") for r in rows), key=str)
    assert data.contigs == [("c1", 300_000), ("c2", 300_000), ("c10", 300_000)] and data.text.startswith("@HD")
    places = [(["c1", "c2", "c10", None].index(r.chrom), r.pos) for r in data.alignments.select("chrom", "pos").collect()]
    assert places == sorted(places)


def plain_depth(rows):
    found = Counter()
    for _, flag, chrom, pos, _, text in rows:
        if flag & depth.UNUSED or chrom is None:
            continue
        for n, op in re.findall(r"(\d+)(.)", text):
            if op in "M=X":
                found.update((chrom, x) for x in range(pos, pos + int(n)))
            pos += int(n) if op in "MDN=X" else 0
    return found


def test_depth(spark, alignments, tmp_path):
    path, rows = alignments
    want, reads = plain_depth(rows), bam.read_bam(spark, path, 100_000).alignments
    got = {(r.chrom, x): r.depth for r in depth.depth_runs(reads).collect() for x in range(r["first"], r["last"] + 1)}
    assert got == dict(want)
    variants = spark.createDataFrame([(c, x) for c in ("c1", "c2", "c3") for x in range(1, 260_000, 97)] + [("c1", 1)], "CHROM string, POS int")
    at = {(r.chrom, r.pos): r.depth for r in depth.depth_at_positions(variants, reads).collect()}
    assert len(at) == variants.distinct().count() and all(n == want[k] for k, n in at.items())
    more = variants.select("CHROM", "POS", *(F.lit(".").alias(c) for c in ("ID", "REF", "ALT", "QUAL", "FILTER", "INFO")))
    vcf.write_vcf(vcf.VcfData([], [], more), str(tmp_path / "v.vcf.gz"), gzip=True)
    depth.bam_depth_at_positions(spark, path, str(tmp_path / "v.vcf.gz"), str(tmp_path / "d.tsv"))
    lines = [x.split("\t") for x in (tmp_path / "d.tsv").read_text().splitlines()]
    assert {(c, int(p)): int(n) for c, p, n in lines} == {k: n for k, n in at.items() if n}
    assert [("c1", "c2").index(c) for c, _, _ in lines] == sorted(("c1", "c2").index(c) for c, _, _ in lines)


def test_depth_sends_no_alignments_to_the_driver(spark, alignments):
    """What is read from a file is not taken for the few bytes of its tasks' numbers, which made Spark broadcast it and sweep in one task."""
    reads = bam.read_bam(spark, alignments[0]).alignments
    for df in (depth.depth_runs(reads), depth.depth_at_positions(reads.select(F.col("chrom").alias("CHROM"), F.col("pos").alias("POS")), reads)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_alignments_are_sorted_with_each_value_once(spark, alignments, monkeypatch, tmp_path):
    seen, write = [], bam.write_records
    monkeypatch.setattr(bam, "write_records", lambda records, *rest, **how: (seen.append(records), write(records, *rest, **how)))
    data, path = bam.read_bam(spark, alignments[0]), str(tmp_path / "again.bam")
    bam.write_bam(data.alignments, data.contigs, path, data.text)
    names = [*seen[0].schema["_ord"].dataType.names, *seen[0].columns]
    assert len(set(names)) == len(names) == 7
    assert sorted(map(str, bam.read_bam(spark, path).alignments.collect())) == sorted(map(str, data.alignments.collect()))


def test_alignments_that_cannot_be_packed(spark, tmp_path):
    for row in (("r" * 255, 0, "c1", 5, 0, [16]), ("r", 0, "c1", 5, 256, [16]), ("r", 0, "c1", 5, 0, None)):
        df = spark.createDataFrame([row], "name string, flag int, chrom string, pos int, mapq int, cigar array<int>")
        with pytest.raises(Exception, match="out of its range|lacks"):
            bam.write_bam(df, [("c1", 100)], str(tmp_path / "x.bam"))


def test_other_files_are_no_alignments(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(bgzf.block(b"something else") + bgzf.END)
    with pytest.raises(ValueError, match="no binary alignment"):
        bam.read_bam(spark, str(tmp_path / "x.bam"))


def test_records_that_are_guessed_wrong_are_errors(spark, alignments, monkeypatch):
    path, _ = alignments
    real = bam._guess
    monkeypatch.setattr(bam, "_guess", lambda *a: real(*a) + 1)
    with open(path, "rb") as f:
        blocks = bgzf.Blocks(f, os.path.getsize(path))
        _, contigs, start, within = bam._header(blocks)
        with pytest.raises(ValueError, match="told apart"):
            list(bam._read_range(blocks, start, 100_000, within, [n for _, n in contigs], bam.pa.array([*(c for c, _ in contigs), None])))


# ---------------------------------------------------------------- matrices


@pytest.mark.parametrize("text, want", [
    ("coordinate pattern general\n% x\n\n3 3 3\n1 1\n2 3\n3 3\n", [(1, 1, 1), (2, 3, 1), (3, 3, 1)]),
    ("coordinate real general\n3 3 4\n3 3 4\n1 1 0.5\n1 1 0.25\n2 1 -1e-3\n", [(1, 1, 0.75), (2, 1, -0.001), (3, 3, 4.0)]),
    ("coordinate real symmetric\n3 3 3\n1 1 0.5\n3 1 -2.25\n3 3 1e-3\n", [(1, 1, 0.5), (1, 3, -2.25), (3, 1, -2.25), (3, 3, 0.001)]),
    ("coordinate integer skew-symmetric\n3 3 1\n2 1 5\n", [(1, 2, -5), (2, 1, 5)]),
    ("coordinate pattern symmetric\n2 2 2\n1 1\n2 1\n", [(1, 1, 1), (1, 2, 1), (2, 1, 1)]),
    ("array real general\n2 3\n1\n2\n0\n4.5\n5\n6\n", [(1, 1, 1.0), (1, 3, 5.0), (2, 1, 2.0), (2, 2, 4.5), (2, 3, 6.0)]),
    ("array integer symmetric\n3 3\n1\n2\n3\n% c\n4\n5\n6\n", [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 2), (2, 2, 4), (2, 3, 5), (3, 1, 3), (3, 2, 5), (3, 3, 6)]),
    ("array integer skew-symmetric\n3 3\n1\n2\n3\n", [(1, 2, -1), (1, 3, -2), (2, 1, 1), (2, 3, -3), (3, 1, 2), (3, 2, 3)]),
    ("coordinate integer general\n4 4 0\n", []),
])
def test_kinds_of_matrices(spark, tmp_path, text, want):
    (tmp_path / "m").write_text(f"%%MatrixMarket matrix {text}")
    assert sorted(map(tuple, mtx.read_mtx(spark, str(tmp_path / "m"))[0].collect())) == want


def test_places_of_large_symmetric_arrays(spark, tmp_path):
    n = 60
    values = [(r, c) for c in range(1, n + 1) for r in range(c, n + 1)]
    (tmp_path / "m").write_text(f"%%MatrixMarket matrix array integer symmetric\n{n} {n}\n" + "".join(f"{r * 1000 + c}\n" for r, c in values))
    got = {(r.row, r.col): r.value for r in mtx.read_mtx(spark, str(tmp_path / "m"))[0].collect()}
    assert got == {k: r * 1000 + c for r, c in values for k in ((r, c), (c, r))}


@pytest.mark.parametrize("text, why", [("%%MatrixMarket matrix coordinate complex general\n1 1 0\n", "complex"), ("1 1 0\n", "banner"), ("%%MatrixMarket matrix coordinate integer general\n3 3 4\n1 1 1\n", "states 4"), ("%%MatrixMarket matrix array pattern general\n1 1\n", "pattern"), ("%%MatrixMarket matrix coordinate real symmetric\n2 3 0\n", "3 columns"), ("", "banner"), ("%%MatrixMarket matrix coordinate real hermitian\n1 1 0\n", "hermitian")])
def test_matrices_that_cannot_be_read(spark, tmp_path, text, why):
    (tmp_path / "m").write_text(text)
    with pytest.raises(ValueError, match=why):
        mtx.read_mtx(spark, str(tmp_path / "m"))
