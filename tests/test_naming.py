import os.path
import random

import pytest

from caseloom.operators.naming import unique_names
from caseloom.operators.ranking import running_total
from pyspark.sql import functions as F


def one_by_one(rows):
    """The rule itself: each file in turn takes the first free name of its folder."""
    taken, out = {}, {}
    for folder, order, name in sorted(rows, key=lambda r: (r[0], r[1])):
        names = taken.setdefault(folder, set())
        stem, ext = os.path.splitext(name)
        free, number = name, 0
        while free in names:
            number += 1
            free = f"{stem}_{number}{ext}"
        names.add(free)
        out[folder, order] = free
    return out


def named(spark, rows, **options):
    frame = spark.createDataFrame(rows, "folder string, ord long, file_name string")
    result = unique_names(frame, ["folder"], **options).collect()
    assert len(result) == len(rows)
    return {(r.folder, r.ord): r.dest_name for r in result}


def test_fixture(spark):
    rows = [("f", 0, "a.txt"), ("f", 1, "a.txt"), ("f", 2, "a_1.txt"), ("g", 0, "a.txt")]
    assert list(named(spark, rows).values()).count("a_1_1.txt") == 1
    assert named(spark, rows) == one_by_one(rows)


@pytest.mark.parametrize("chunk_rows", [3, 1 << 16])
def test_random_clashes(spark, chunk_rows):
    pool = ["a.txt", "a_1.txt", "a_1_1.txt", "a_2.txt", "a_2_1.txt", "a_3.txt", "a_01.txt", ".x", ".x_1", "...", "..._1", "._1.txt",
            "..txt", "..txt_1", "b", "b_1", "b_2", "b_10", "a.b_1", "a.b", "a_1.b", "_1.txt", ".txt", ".txt_1", "a_1_1_1.txt"]
    draw = random.Random(7)
    rows = []
    for folder in range(25):
        names = draw.sample(pool, draw.randint(2, len(pool)))
        rows += [(f"f{folder}", order * 3, draw.choice(names)) for order in range(draw.randint(1, 120))]
    draw.shuffle(rows)
    assert named(spark, rows, chunk_rows=chunk_rows) == one_by_one(rows)


def test_one_name_holds_most_rows(spark):
    rows = [("f", i, "scan.pdf") for i in range(3000)] + [("f", 10_000 + i, f"scan_{i}.pdf") for i in range(0, 900, 3)]
    rows += [("f", 5_000 + i, f"scan_{i}.pdf") for i in range(2_990, 3_010)]
    got = named(spark, rows, chunk_rows=64)
    assert got == one_by_one(rows) and len(set(got.values())) == len(rows)


def test_no_clash_path(spark):
    rows = [("f", i, f"page_{i % 7}.txt") for i in range(70)] + [(None, 1, "x")]
    got = named(spark, rows)
    assert got[None, 1] == "x" and got["f", 7] == "page_0_1.txt" and got["f", 69] == "page_6_9.txt"


def test_running_total(spark):
    rows = [(k, i, i % 5) for k in ("hot", None) for i in range(200)]
    frame = spark.createDataFrame(rows, "k string, o long, v long")
    for chunk in (1, 16, 1000):
        got = {(r.k, r.o): r.s for r in running_total(frame, ["k"], "o", F.col("v"), "s", chunk_rows=chunk).collect()}
        assert got == {(k, i): sum(j % 5 for j in range(i)) for k, i, _ in rows}
