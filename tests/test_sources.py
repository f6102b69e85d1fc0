"""Literal records of each format, and the cleaning rules."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from blocktrace.operators import clean
from blocktrace.sources import raw, synthetic, tables, workloads

MSR = """128166372010810581,mds,0,Write,2654453760,4096,54086
128166372011594132,mds,0,Write,3154132992,4096,51785
128166372011600556,mds,0,Write,3201662976,20480,45361
128166372011606862,mds,0,Read,3154124800,4096,39055
128166372017062367,mds,0,Write,57819138,8192,52301
128166372018000000,mds,0,Write,2654453760,4096,1000
"""
FIU = """777599999908936 2552 kjournald 160806224 8 W 6 0 abc
777599999953380 2552 kjournald 73397240 8 W 6 0 def
777600000000000 2552 kjournald 160806224 16 W 6 0 aaa
777600000500000 4253 nfsd 160806232 8 R 6 0 bbb
777601000000000 2552 kjournald 160806224 8 W 6 0 ccc
"""
FIU_MIXED = """1000000 1 p 96 8 W 6 0 a
2000000 1 p 200 8 W 6 0 b
3000000 1 p 96 8 W 8 1 c
4000000 1 p 96 8 W 6 0 d
"""
SYSTOR = """Timestamp,Response,IOType,LUN,Offset,Size
1456135200.013118000,0.001,W,0,4096,4096
1456135200.113118000,0.001,R,0,8192,4096
1456135201.013118000,0.001,W,0,4096,8192
1456135202.013118000,0.001,,0,4096,4096
1456135203.013118000,0.001,W,0,4096,4096
"""


@pytest.fixture()
def parse(spark, tmp_path):
    def run(dataset, text, name="trace.csv", device="auto", limits=clean.Limits(), max_records=None):
        path = tmp_path / name
        opener = gzip.open if name.endswith(".gz") else open
        with opener(path, "wt") as handle:
            handle.write(text)
        requests = raw.read_requests(spark, dataset, str(path), "t")
        if max_records is not None:
            requests = clean.request_prefix(requests, max_records)
        checked = clean.check_requests(clean.select_device(requests, device), limits)
        audit = clean.parse_audit(checked, limits).first()
        return clean.normalize(checked).orderBy("seq").collect(), audit
    return run


def test_msr_expands_and_converts(parse):
    rows, audit = parse("msr", MSR, "mds 0.csv")
    assert len(rows) == 12 and [r["seq"] for r in rows] == list(range(12))
    assert (audit["raw_records_read"], audit["records_accepted"], audit["dropped_total"]) == (6, 6, 0)
    assert (audit["multi_block_requests"], audit["unaligned_requests"]) == (2, 1)
    assert (audit["write_records"], audit["read_records"]) == (5, 1)
    assert (rows[0]["timestamp"], rows[0]["lba"], rows[1]["timestamp"]) == (0, 648060, 78355)
    assert [r["lba"] for r in rows if r["timestamp"] == 78997] == list(range(781656, 781661))
    assert sorted(r["lba"] for r in rows if 14000 < r["lba"] < 15000) == [14116, 14117, 14118]
    assert audit["device_record_counts"] == {"mds_0": 6}


def test_gzip_and_header_read_alike(parse):
    plain, _ = parse("msr", MSR, "a.csv")
    packed, _ = parse("msr", MSR, "b.csv.gz")
    headed, audit = parse("msr", "Timestamp,Hostname,DiskNumber,Type,Offset,Size,ResponseTime\n\n" + MSR, "c.csv")
    assert plain == packed == headed
    assert audit["raw_records_read"] == 6


def test_mixed_volumes_are_refused(parse):
    text = ("128166372010810581,hm,0,Write,409600,4096,1\n"
            "128166372010810582,hm,1,Write,409600,4096,1\n")
    with pytest.raises(clean.MultipleDevicesError):
        parse("msr", text)
    rows, audit = parse("msr", text, device="hm_0")
    assert len(rows) == 1 and audit["dropped_other_device"] == 1


def test_fiu_units_and_devices(parse):
    rows, audit = parse("fiu", FIU, "homes.txt")
    assert len(rows) == 6 and rows[0]["lba"] == 160806224 * 512 // 4096
    assert rows[1]["timestamp"] == 777599999953380 // 1000 - 777599999908936 // 1000
    assert list(audit["device_record_counts"]) == ["6:0"]
    with pytest.raises(clean.MultipleDevicesError):
        parse("fiu", FIU_MIXED, "mixed.txt")
    rows, audit = parse("fiu", FIU_MIXED, "mixed.txt", device="dominant")
    assert len(rows) == 3 and audit["dropped_other_device"] == 1


def test_systor_units_and_blank_type(parse):
    rows, audit = parse("systor", SYSTOR, "2016022207-LUN0.csv")
    assert len(rows) == 5 and audit["raw_records_read"] == 5
    assert audit["dropped_unknown_operation"] == 1
    assert audit["unknown_operation_examples"] == ["BLANK"]
    assert (rows[0]["lba"], rows[1]["timestamp"]) == (1, 100000)


def test_every_drop_is_counted(parse):
    text = """128166372010810581,hm,0,Write,4096,4096,1
not_a_number,hm,0,Write,4096,4096,1
128166372010810583,hm,0,Flush,4096,4096,1
128166372010810584,hm,0,Write,-1,4096,1
128166372010810585,hm,0,Write,4096,0,1
128166372010810586,hm,0,Write,4096,99999999,1
128166372010810587,hm,0,Write,4096,4096,1,spare,columns
"""
    rows, audit = parse("msr", text, limits=clean.Limits(max_blocks=8))
    assert len(rows) == 1 and audit["dropped_total"] == 5
    for reason in ("malformed", "unknown_operation", "bad_offset", "bad_size", "oversized_request"):
        assert audit[f"dropped_{reason}"] == 1
    assert audit["unknown_operation_examples"] == ["FLUSH"]
    assert audit["skipped_extra_columns"] == 1


def test_shuffled_file_is_put_in_order(parse):
    lines = MSR.splitlines()
    shuffled = "\n".join(lines[i] for i in (3, 0, 5, 1, 2, 4)) + "\n"
    rows, audit = parse("msr", shuffled)
    times = [r["timestamp"] for r in rows]
    assert times == sorted(times) and audit["out_of_order_records"] > 0


def test_prefix_is_the_head_of_the_file(parse):
    full, _ = parse("msr", MSR)
    head, audit = parse("msr", MSR, max_records=3)
    assert audit["raw_records_read"] == 3
    assert [r["lba"] for r in head] == [r["lba"] for r in full][:len(head)]


def test_empty_file(spark, tmp_path):
    path = tmp_path / "empty.csv"
    path.write_text("")
    checked = clean.check_requests(raw.read_msr(spark, str(path), "t"))
    assert clean.normalize(checked).count() == 0


def test_files_of_a_workload_keep_name_order(spark, tmp_path):
    for hour in (9, 7, 8):
        (tmp_path / f"20160222{hour:02d}-LUN0.csv").write_text(
            f"h\n{hour}.5,0,W,0,{hour * 4096},4096\n{hour}.5,0,W,0,{hour * 4096 + 4096},4096\n")
    rows = raw.read_systor(spark, str(tmp_path), "t").orderBy("file_index", "block_start", "line_id").collect()
    assert [r["offset_bytes"] // 4096 for r in rows] == [7, 8, 8, 9, 9, 10]
    assert [r["file_index"] for r in rows] == [0, 0, 1, 1, 2, 2]


def test_workload_discovery(spark):
    names = ["2016022208-LUN1.csv.gz", "2016022207-LUN1.csv.gz", "2016022207-lun2.csv", "README.txt",
             "all.tar.gz", "2016022207-LUN1.csv.gz.part", "other.csv"]
    files = spark.createDataFrame([(f"/raw/{n}", 1, n) for n in names], "path string, length long, name string")
    found = workloads.discover(files, "systor").orderBy("trace_id", "file_index").collect()
    assert [(r["trace_id"], r["path"][5:15]) for r in found] == [
        ("systor_lun1", "2016022207"), ("systor_lun1", "2016022208"), ("systor_lun2", "2016022207")]
    msr = spark.createDataFrame([("/raw/hm_0.csv.gz", 1, "hm_0.csv.gz")], files.schema)
    assert workloads.discover(msr, "msr").first()["trace_id"] == "msr_hm_0"


def test_header_of_a_trace_table_is_verified(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("timestamp,lba,size,operation,trace_id\n5,1,1,W,t\n6,x,1,W,t\n7,2,2,W,t\n8,-1,1,W,t\n9,1,1,Q,t\n")
    bad.write_text("lba,timestamp,size,operation,trace_id\n5,1,1,W,t\n")
    counts = tables.reason_counts(tables.check_trace(
        tables.read_text_table(spark, str(good), tables.TRACE_TEXT))).collect()
    assert {r["reason"]: r["records"] for r in counts} == {
        "ok": 1, "malformed": 1, "non_unit_size": 1, "negative_lba": 1, "unknown_operation": 1}
    with pytest.raises(Exception, match="header|CSV"):
        tables.read_text_table(spark, str(bad), tables.TRACE_TEXT).collect()


def test_rows_of_several_files_are_numbered_in_file_order(spark, tmp_path):
    """The last file is the largest, which a reader would take first."""
    start, sizes = 0, (3, 1, 900)
    for name, size in zip("abc", sizes):
        lines = [f"{t},{t},1,W,t" for t in range(start, start + size)]
        (tmp_path / f"{name}.csv").write_text("\n".join(["timestamp,lba,size,operation,trace_id", *lines]) + "\n")
        start += size
    rows = tables.typed_trace(tables.check_trace(
        tables.read_text_table(spark, str(tmp_path), tables.TRACE_TEXT))).collect()
    assert len(rows) == sum(sizes) and all(r["seq"] == r["timestamp"] for r in rows)


def test_synthetic_traffic_is_skewed(spark):
    made = synthetic.skewed_writes(spark, 24_000, 60, 0.25, 0.80)
    hot = made.filter(F.col("lba") < 15).count() / 24_000
    assert 0.78 < hot < 0.82 and made.agg(F.max("lba")).first()[0] == 59
    for arguments in ((0, 0.5, 0.5), (10, 1.0, 0.5), (10, 0.5, 1.5)):
        with pytest.raises(ValueError):
            synthetic.skewed_writes(spark, 10, *arguments)


def test_files_are_written_with_their_text_in_folders(spark, tmp_path):
    """Many small files below few folders, as the checksum query writes them, are listed and verified."""
    rows = [(f"part={i // 10}/{i}.txt", f"text {i}\n") for i in range(30)]
    files = spark.createDataFrame(rows, "name string, value string")
    workloads.write_files(files.repartition(3), str(tmp_path / "raw"))
    assert {f"{p.parent.name}/{p.name}": p.read_text() for p in (tmp_path / "raw").rglob("*.txt")} == dict(rows)
    published = files.select("name", F.sha2("value", 256).alias("expected"))
    done = workloads.verify_checksums(spark, str(tmp_path / "raw"), published, depth=2).collect()
    assert len(done) == 30 and {r["status"] for r in done} == {"OK"}


def test_rows_are_typed_before_they_are_ordered(spark, monkeypatch):
    """What one task puts in order holds numbers, not their text, and no column that isn't returned."""
    rows = [("5", "2", "1", " W ", "a", 0, 0, i) for i in range(3)] + [("x", "2", "1", "W", "a", 0, 0, 3)]
    text = spark.createDataFrame(rows, "timestamp string, lba string, size string, operation string, trace_id string, "
                                       "file_index int, block_start long, line_id long")
    seen, ordinal = [], tables.with_ordinal
    monkeypatch.setattr(tables, "with_ordinal", lambda df, *args: seen.append(dict(df.dtypes)) or ordinal(df, *args))
    got = tables.typed_trace(tables.check_trace(text)).collect()
    assert sorted(tuple(r) for r in got) == [(5, 2, 1, "W", i, "a") for i in range(3)]
    assert seen[0]["timestamp"] == seen[0]["lba"] == "bigint" and not {"size", "reject_reason"} & set(seen[0])
