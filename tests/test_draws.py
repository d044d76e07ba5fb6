"""Seeded draws against a plain loop, and manifests that are absent, blank, whole or damaged."""

import hashlib

import pytest

from ledgerloom.operators import draws
from ledgerloom.sources.connectors import append_manifest, read_manifest

PROSE, LIST, SHORT = "p" * 320, "\n".join(["item"] * 80), "s"
SCHEMA = "case_id long, para long, text string, turn long"


def md5(*of):
    return hashlib.md5(":".join("" if x is None else str(x) for x in of).encode()).hexdigest()


def plain(rows, seed, count):
    cases = {}
    for case, para, text, _ in rows:
        cases.setdefault(case, []).append((para, text or ""))
    targets, examined, no_long, no_prose, rejected = set(), 0, 0, 0, 0
    for case in sorted(cases, key=lambda c: (md5(seed, c), c is not None, c or 0)):
        if len(targets) >= count:
            break
        examined += 1
        long = [(p, t) for p, t in cases[case] if len(t) >= 300]
        fits = [(p, t) for p, t in long if len(t) / len([x for x in t.split("\n") if x]) >= 200]
        rejected += len(long) - len(fits)
        no_long += not long
        no_prose += bool(long) and not fits
        if fits:
            targets.add((case, *min(fits, key=lambda x: md5(seed, case, x[0]))))
    return targets, (examined, no_long, no_prose, rejected)


@pytest.mark.parametrize("count", [0, 1, 7, 40, 1000])
def test_draw_against_a_loop(spark, count):
    kinds = [[PROSE, PROSE + "x", LIST], [LIST, LIST], [SHORT, None, ""], [PROSE], [LIST, PROSE + "\n" + PROSE, SHORT], ["\n" * 400]]
    rows = [(c if c else None, p, (t or "") + str(c) if t and t.strip() else t, 0) for c in range(60) for p, t in enumerate(kinds[c % 5])]
    targets, counts = draws.drawn(spark.createDataFrame(rows, SCHEMA).repartition(3), 5, count)
    expected, told = plain(rows, 5, count)
    assert {tuple(r) for r in targets.collect()} == expected
    assert tuple(counts.first()) == told


def test_draw_of_nothing_and_of_blank_lines(spark):
    for rows in ([], [(1, 0, "\n" * 400, 0)]):
        targets, counts = draws.drawn(spark.createDataFrame(rows, SCHEMA), 5, 3)
        assert targets.collect() == [] and tuple(counts.first()) == ((1, 0, 1, 1) if rows else (0, 0, 0, 0))


def test_paragraphs_hold_all_lines(spark):
    texts = [(1, "a\nb\nc\nd"), (2, ""), (3, None), (4, "x\n\ny\n")]
    rows = draws.by_lines(spark.createDataFrame(texts, "case_id long, text string")).orderBy("case_id", "para").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "a\nb\nc"), (1, 1, "d"), (2, 0, ""), (3, 0, ""), (4, 0, "x\n\ny"), (4, 1, "")]


def test_manifest(spark, tmp_path):
    path, schema = str(tmp_path / "runs"), "run long, note string"
    assert read_manifest(spark, path, schema).collect() == []
    for run in (1, 2):
        append_manifest(spark.createDataFrame([(run, 'a "b"\nc'), (run, None)], schema), path)
    (tmp_path / "runs" / "blank.json").write_text("\n  \n")
    assert sorted((r["run"], r["note"]) for r in read_manifest(spark, path, schema).na.fill("-").collect()) == [(1, "-"), (1, 'a "b"\nc'), (2, "-"), (2, 'a "b"\nc')]


@pytest.mark.parametrize("line", ['{"run": 3, "no', "plain", "[1"])
def test_damaged_manifest(spark, tmp_path, line):
    path = str(tmp_path / "runs")
    append_manifest(spark.createDataFrame([(1, "a")], "run long, note string"), path)
    (tmp_path / "runs" / "cut.json").write_text('{"run": 2, "note": "b"}\n' + line)
    for use in (lambda rows: rows.count(), lambda rows: rows.select("run").collect()):
        with pytest.raises(Exception, match="cut.json: the manifest is damaged"):
            use(read_manifest(spark, path, "run long, note string"))
