"""The job machine as a stream and over a table: illegal steps, timeouts, replayed files; inserts and upserts; artifacts; charsets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import artifacts, pages
from ledgerloom.streaming import jobs
from ledgerloom.streaming.flows import upserted

MIN = 60_000_000
SCHEMA = "job long, ts timestamp, number long, event string"


def at(minutes):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minutes)


EVENTS = [
    (1, at(0), 1, "start"), (1, at(5), 2, "extracted"), (1, at(6), 3, "start"), (1, at(7), 4, "confirm"), (1, at(8), 5, "retry"),  # two steps refused
    (2, at(0), 6, "start"), (2, at(25), 7, "extracted"), (2, at(26), 8, "retry"), (2, at(27), 9, "start"), (2, at(47), 10, "failed"),  # too long; exactly 20 minutes
    (3, at(1), 11, "dismiss"), (3, at(2), 12, "start"),  # nothing ends it
    (None, at(1), 13, "start"), (4, None, 14, "start"), (5, at(9), 15, "unknown"),
    (9, at(5000), 16, "start"),  # moves the clock on
]
STEPS = {
    (1, 1, "EXTRACTING", 1), (1, 2, "PENDING_REVIEW", 1), (1, 3, "refused", 1), (1, 4, "CONFIRMED", 1), (1, 5, "refused", 1),
    (2, 6, "EXTRACTING", 1), (2, -1, "FAILED", 1), (2, 7, "refused", 1), (2, 8, "PENDING", 1), (2, 9, "EXTRACTING", 2), (2, 10, "FAILED", 2),
    (3, 11, "refused", 0), (3, 12, "EXTRACTING", 1), (3, -1, "FAILED", 1), (5, 15, "refused", 0), (9, 16, "EXTRACTING", 1),
}


def steps(df):
    out = [(r["job"], r["number"], r["after"], r["attempts"]) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


def stream(spark, folder, batches, late="30 minutes"):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(folder))


def test_table(spark):
    end = int(at(5000).timestamp() * 1_000_000)
    told = jobs.told_of(spark.createDataFrame(EVENTS, SCHEMA), until=end)
    assert steps(told) == STEPS
    late = told.where("job = 3 AND number = -1").first()
    assert late["us"] == int(at(22).timestamp() * 1_000_000) and late["event"] == "timeout"


def test_stream_in_many_batches(spark, tmp_path):
    """One file a trigger, then files that only move the clock, so that timers run out; the same steps as over the table."""
    batches = [[e] for e in sorted(EVENTS, key=lambda e: e[1] or at(0))] + [[(9, at(6000 + i), 20 + i, "noise")] for i in range(2)]
    told = upserted(jobs.transitions(stream(spark, tmp_path / "in", batches), late="30 minutes"), ["job", "us", "number", "event"], mode="append")
    assert {s for s in steps(told) if s[0] != 9} == {s for s in STEPS if s[0] != 9}


def test_a_replayed_file_inserts_nothing(spark, tmp_path):
    rows = [(1, at(0), 1, "a"), (1, at(3), 2, "b"), (2, at(4), 3, "a")]
    late = [(1, at(60 * 24 * 200), 4, "a"), (1, at(60 * 24 * 200 + 1), 5, "z")]
    source = stream(spark, tmp_path / "in", [rows, rows, [(1, at(60 * 24 * 150), 9, "q")], [(1, at(60 * 24 * 195), 10, "r")], [(1, at(60 * 24 * 196), 11, "r")], late])
    got = upserted(jobs.first_inserts(source, ["job", "event"]).select("job", "event", "number"), ["job", "event", "number"], mode="append")
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1), (1, "a", 4), (1, "b", 2), (1, "q", 9), (1, "r", 10), (1, "z", 5), (2, "a", 3)]  # within the window once


def test_latest_generation_wins(spark, tmp_path):
    source = stream(spark, tmp_path / "in", [[(1, at(0), 5, "q")], [(1, at(1), 9, "q"), (1, at(1), 7, "q")], [(1, at(2), 2, "p")]])
    got = upserted(jobs.newest(source, ["event"], "number"), ["event"])
    assert sorted(map(tuple, got.collect())) == [("p", 2, 1), ("q", 9, 3)]


SECTIONS = [("terms", "json", b'["a","b"]'), ("rows", "u32", b"\1\0\0\0\2\0\0\0"), ("vectors", "f32", b"\0\0\x80?"), ("empty", "int8", b"")]


def written(spark, folder, **options):
    spark.dataSource.register(artifacts.ArtifactSource)
    rows = spark.createDataFrame(SECTIONS, "name string, kind string, data binary").coalesce(1)
    rows.write.format("sections").mode("overwrite").options(build="b1", **options).save(str(folder))
    return next(folder.glob("*.bin"))


def test_artifact_round_trip(spark, tmp_path):
    file = written(spark, tmp_path)
    written(spark, tmp_path)  # takes the place of the first
    assert [f for f in tmp_path.iterdir() if not f.name.startswith(".")] != [file] and len(list(tmp_path.glob("*.bin"))) == 1
    back = spark.read.format("sections").option("build", "b1").load(str(tmp_path)).collect()
    assert sorted((r["name"], r["kind"], bytes(r["data"])) for r in back) == sorted(SECTIONS)
    data = next(tmp_path.glob("*.bin")).read_bytes()
    assert all((int.from_bytes(data[8:12], "little") + at) % 8 == 0 for at in (0,)) and len(data) % 8 == 0


@pytest.mark.parametrize("harm, told", [(lambda d: b"XXXX" + d[4:], "magic"), (lambda d: d[:-16], "cut within section"), (lambda d: d[:6], "cut before"), (lambda d: d[:40], "cut within its header"), (lambda d: d.replace(b'"formatVersion": 2', b'"formatVersion": 7'), "version 7"), (lambda d: d.replace(b'"size": 8', b'"size": 7'), "whole u32"), (lambda d: d.replace(b"b1", b"b2"), "build b2")])
def test_harmed_artifacts_are_errors(spark, tmp_path, harm, told):
    file = written(spark, tmp_path)
    file.write_bytes(harm(file.read_bytes()))
    for crc in tmp_path.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match=told):
        spark.read.format("sections").option("build", "b1").load(str(tmp_path)).collect()


def test_float32(spark):
    df = spark.createDataFrame([(1, [0.1, -2.5]), (2, []), (3, None)], "i long, v array<double>").select("i", artifacts.packed_float32(F.col("v")).alias("b"))
    back = {r["i"]: r["v"] for r in df.select("i", artifacts.unpacked_float32(F.col("b")).alias("v")).collect()}
    assert back[2] == [] and back[3] is None and back[1][1] == -2.5 and abs(back[1][0] - 0.1) < 1e-8
    assert bytes(df.where("i = 1").first()["b"]) == b"\xcd\xcc\xcc=\x00\x00 \xc0"
    with pytest.raises(Exception, match="whole f32"):
        spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(artifacts.unpacked_float32(F.col("b"))).collect()


def test_charsets(spark, tmp_path):
    text = "<html>L’élu paie 5 €</html>"
    pages_ = {"latin.html": "<meta charset=latin1>" + text, "utf8.html": '<meta http-equiv="c" content="text/html; charset=utf-8">' + text, "none.html": text, "broken.html": "<meta charset=utf-8>x"}
    for name, page in pages_.items():
        (tmp_path / name).write_bytes(page.encode("utf-8" if "utf8" in name or "broken" in name else "cp1252") + (b"\xe9\xff" if "broken" in name else b""))
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["charset"], r["damaged"]) for r in pages.page_files(spark, str(tmp_path)).collect()}
    assert got == {n: (p + ("��" if "broken" in n else ""), "windows-1252" if n in ("latin.html", "none.html") else "utf-8", 2 * ("broken" in n)) for n, p in pages_.items()}
    wide = spark.createDataFrame([(bytearray("﻿héé".encode("utf-16-le")), "text/html; charset=UTF-16LE"), (None, None), (bytearray(b""), "charset=nonsense")], "b binary, t string")
    rows = [tuple(r["d"]) for r in wide.select(pages.decoded(F.col("b"), F.col("t")).alias("d")).collect()]
    assert rows == [("héé", "utf-16le", 0), (None, None, 0), ("", "windows-1252", 0)]
