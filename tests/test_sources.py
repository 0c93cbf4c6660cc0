"""Sources and sinks: order kept over many tasks, counts taken while reading, nothing published that fails."""

import os
import random

import pytest

from lucerna.sources import files


def test_id_lists_keep_file_order_over_many_splits(spark, tmp_path):
    rnd = random.Random(1)
    want = []
    for name in ("a.txt", "b.txt", "c.txt"):
        lines = [rnd.choice(["", "  ", f"id{rnd.randint(0, 9)}", f" {name}-{i} "]) for i in range(4000)]
        (tmp_path / name).write_text("\r\n".join(lines) if name == "b.txt" else "\n".join(lines))
        want += [x.strip() for x in lines if x.strip()]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = files.read_id_list(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        assert [tuple(r) for r in got.orderBy("position").collect()] == list(enumerate(want, 1))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    (tmp_path / "none").mkdir()
    (tmp_path / "none/x.txt").write_text("\n \n")
    assert files.read_id_list(spark, str(tmp_path / "none")).count() == 0


def test_counts_are_taken_in_the_pass_that_reads(spark, tmp_path):
    spark.range(50).write.parquet(str(tmp_path / "in"))
    reads = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    rows = spark.read.parquet(str(tmp_path / "in")).mapInArrow(noted, "id long")
    kept = files.require_count(rows, 50)
    assert kept.count() == 50 and reads.value == 50
    with pytest.raises(ValueError, match="50 rows, not 49"):
        files.require_count(rows, 49)


def test_a_wrong_count_publishes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="10 items, not 11"):
        files.write_counted(spark.range(10), out, 11, "items")
    assert os.listdir(tmp_path) == []
    files.write_counted(spark.range(10), out, 10)
    assert spark.read.parquet(out).count() == 10 and os.listdir(tmp_path) == ["out"]
    with pytest.raises(ValueError, match="exists"):
        files.write_counted(spark.range(10), out, 10)
