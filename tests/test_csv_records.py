"""The parallel CSV reader against Spark's reader of one task a file."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reviewlake.sources import csv_records as cr
from reviewlake.sources import tables

SCHEMA = "a string, b string, n int"


def plain_state(line, open_):
    """Whether quotes are open after a line, sign by sign."""
    at_start, i = not open_, 0
    while i < len(line):
        c = line[i]
        if open_:
            if c == '"' and line[i + 1 : i + 2] == '"':
                i += 1
            elif c == '"':
                open_, at_start = False, False
        elif c == '"' and at_start:
            open_, at_start = True, False
        else:
            at_start = c == ","
        i += 1
    return open_


def test_effects_of_lines_equal_plain_scan():
    rng = random.Random(1)
    lines = ["".join(rng.choice('"",,ab ') for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    opens, stays = cr.line_effects(pa.array(lines))
    for line, o, s in zip(lines, opens, stays, strict=True):
        assert o == plain_state(line, False) and s == plain_state(line, True), line


@pytest.mark.parametrize("start", [False, True])
def test_states_are_composed_in_order(start):
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 200):
        opens, stays = rng.random(n) < 0.4, rng.random(n) < 0.6
        state, expected = start, [start]
        for o, s in zip(opens, stays, strict=True):
            state = bool(s if state else o)
            expected.append(state)
        assert cr.open_before(opens, stays, start).tolist() == expected


def quoted(value):
    return '"' + value.replace('"', '""') + '"'


def value(rng, signs='ab ,"\n\n\n'):
    text = "".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 3, 8, 40, 200])))
    needs = any(c in text for c in ',"\n') or rng.random() < 0.2
    return quoted(text) if needs else text


def both(spark, path):
    ours = tables.scan_csv(spark, path, SCHEMA)
    theirs = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(SCHEMA).csv(path)
    return ours, theirs


@pytest.mark.parametrize("seed", range(4))
def test_equal_to_one_task_reader_over_many_ranges(spark, tmp_path, seed):
    rng = random.Random(seed)
    folder = tmp_path / "csv"
    folder.mkdir()
    for k in range(3):
        rows = [f"{value(rng)},{value(rng)},{rng.randint(0, 99)}" for _ in range((250, seed % 2, 60)[k])]
        head = 'a,"b\nname",n' if k == 2 else "a,b,n"
        end = rng.choice(["", "\n"])
        (folder / f"part-{k}.csv").write_text("\n".join([head, *rows]) + end)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        ours, theirs = both(spark, str(folder))
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 10
        assert Counter(map(tuple, ours.collect())) == Counter(map(tuple, theirs.collect()))
        assert cr.csv_records(spark, str(folder)).where("first").count() == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_odd_files(spark, tmp_path):
    cases = {
        "crlf": 'a,b,n\r\n1,"x, y",2\r\n3,,\r\n4,"z",\r\n',
        "blank": "a,b,n\n\n\nx,y,1\n\n",
        "short": "a,b,n\nx\nx,y,1,extra\nx,y,notanumber\n",
        "open end": 'a,b,n\nx,"never closed,1\nand on',
        "stray": 'a,b,n\nx"y,z"w,1\n"q"r,"s" t,2\n',
        "unicode": 'a,b,n\né,"漢\n字",1\n',
        "header only": "a,b,n\n",
        "empty": "",
    }
    for name, content in cases.items():
        path = tmp_path / f"{name}.csv"
        path.write_bytes(content.encode())
        ours, theirs = both(spark, str(path))
        assert sorted(map(tuple, ours.collect()), key=str) == sorted(map(tuple, theirs.collect()), key=str), name


def test_line_breaks_inside_values_stay_as_written(spark, tmp_path):
    path = tmp_path / "crlf.csv"
    path.write_bytes(b'a,b,n\r\n1,"x\r\ny",2\r\n3,"p\nq\rr",4\r\n')
    got = sorted(map(tuple, tables.scan_csv(spark, str(path), SCHEMA).collect()))
    assert got == [("1", "x\r\ny", 2), ("3", "p\nq\rr", 4)]


def test_a_value_longer_than_ranges(spark, tmp_path):
    path = tmp_path / "long.csv"
    long = "line\n" * 2000
    path.write_text(f'a,b,n\nx,"{long}",1\ny,z,2\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = tables.scan_csv(spark, str(path), SCHEMA).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got)) == [("x", long, 1), ("y", "z", 2)]


def test_shuffled_states_give_the_same_rows(spark, tmp_path, monkeypatch):
    path = tmp_path / "t.csv"
    path.write_text("a,b,n\n" + "".join(f'{i},"{"x" * (i % 50)}\n{i}",{i}\n' for i in range(400)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    monkeypatch.setattr(cr, "MAX_BROADCAST_RANGES", 0)
    try:
        ours, theirs = both(spark, str(path))
        assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, theirs.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
