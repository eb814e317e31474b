from __future__ import annotations

import os
import re
import time

import pytest
from pyspark.sql.types import StructType

from quorum.operators import reduce
from quorum.plans import run
from quorum.sources import store

SCHEMA = StructType().add("k", "string").add("v", "long")


@pytest.fixture
def small_splits(spark):
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for c, v in old.items():
        spark.conf.set(c, v)


def _write(folder, name, bad, n=1_000):
    """Lines of uneven length, every tenth one blank; those of ``bad`` are cut off."""
    lines = ["" if k % 10 == 0 else '{"k": "%s", "v": %d}' % ("x" * (k % 37), k) for k in range(1, n + 1)]
    for k in bad:
        lines[k - 1] = '{"k": "cut'
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_malformed_lines_of_files_of_several_splits(spark, tmp_path, small_splits):
    bad = {"a.jsonl": [1, 333, 1_000], "b.jsonl": [457], "c.jsonl": []}
    for name, lines in bad.items():
        _write(tmp_path / "in", name, lines)
    _write(tmp_path / "in", "short.jsonl", [2], n=3)  # packed into one task with a part of another file
    assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 12
    found = store.malformed_lines(spark, str(tmp_path / "in"), SCHEMA).collect()
    assert sorted((os.path.basename(r["file"]), r["line"]) for r in found) == sorted([(f, k) for f, lines in bad.items() for k in lines] + [("short.jsonl", 2)])
    numbers = store.numbered_lines(spark, str(tmp_path / "in" / "c.jsonl")).where("value <> ''").selectExpr("line", "cast(get_json_object(value, '$.v') as long) v")
    assert numbers.count() == 900 and numbers.where("line <> v").count() == 0


def test_the_error_names_the_line(spark, tmp_path, small_splits):
    _write(tmp_path / "in", "a.jsonl", [777])
    with pytest.raises(Exception, match=r"malformed line 777 in \S*a\.jsonl: \{\"k\": \"cut"):
        store.read_lines(spark, str(tmp_path / "in"), SCHEMA).collect()
    with pytest.raises(Exception, match=r"malformed line in \S*a\.jsonl"):
        store.read_lines(spark, str(tmp_path / "in"), SCHEMA, numbered=False).collect()


@pytest.mark.parametrize("numbered", [True, False])
def test_sound_lines_are_read_whole(spark, tmp_path, small_splits, numbered):
    _write(tmp_path / "in", "a.jsonl", [])
    rows = store.read_lines(spark, str(tmp_path / "in"), SCHEMA, numbered)
    assert rows.columns == ["k", "v"] and rows.selectExpr("count(*)", "sum(v)").first()[:] == (900, sum(k for k in range(1, 1_001) if k % 10))
    assert store.read_lines(spark, str(tmp_path / "none"), SCHEMA, numbered).count() == 0


@pytest.mark.parametrize("line", ["7", "[1]", '[{"k": "z"}]', "null", '{"v": "word"}', '{"k"'])
def test_what_is_no_record_is_malformed(spark, tmp_path, line):
    (tmp_path / "x.jsonl").write_text(f'{{"k": "a"}}\n{line}\n')
    with pytest.raises(Exception, match="malformed line 2 in .*" + re.escape(line)):
        store.read_lines(spark, str(tmp_path / "x.jsonl"), SCHEMA).collect()


class Busy:
    """Notes how many calls are in flight over all processes: each is a file while it lasts."""

    def __init__(self, folder):
        self.folder = str(folder)

    def complete(self, prompt, *, model, seed, params):
        own = f"{self.folder}/flight/{prompt}"
        open(own, "w").close()
        seen = len(os.listdir(f"{self.folder}/flight"))
        time.sleep(0.05)
        os.remove(own)
        with open(f"{self.folder}/seen/{prompt}", "w") as out:
            out.write(f"{seen} {os.getpid()}")
        return run.Completion(prompt, 1)


@pytest.mark.parametrize(("limit", "threads", "tasks"), [(8, 2, 4), (3, 2, 1), (2, 5, 1)])
def test_calls_in_flight_over_all_tasks(spark, tmp_path, limit, threads, tasks):
    for name in ("flight", "seen"):
        (tmp_path / name).mkdir()
    calls = spark.range(80).selectExpr("concat('p', id) prompt", "'m' model", "id seed", "'{}' params").repartition(16)
    assert run.run_calls(calls, Busy(tmp_path), str(tmp_path / "cache"), threads=threads, limit=limit).count() == 80
    seen = [(tmp_path / "seen" / f"p{k}").read_text().split() for k in range(80)]
    assert 1 < max(int(n) for n, _ in seen) <= limit
    assert len({pid for _, pid in seen}) <= tasks


def test_limits_below_one_are_refused(spark):
    with pytest.raises(ValueError, match="one at least"):
        run.bounded(spark.range(1), 0, 5)


def test_discordant_counts_refuse_other_values(spark):
    items = spark.createDataFrame([("i1", 1.0, 0.0, 1.0), ("i2", 0.0, 1.0, -1.0), ("i3", 1.0, 1.0, 0.0), ("i4", None, 1.0, None)], "item_id string, x_a double, x_b double, d double")
    assert tuple(reduce.discordant_counts(items).first()) == (3, 1, 1)
    assert tuple(reduce.discordant_counts(items.where("false")).first()) == (0, 0, 0)
    half = items.union(spark.createDataFrame([("i5", 0.5, 1.0, -0.5)], items.schema))
    with pytest.raises(Exception, match="neither pass nor fail: item i5"):
        reduce.discordant_counts(half).collect()
