"""Arrays of flat JSON objects over blocks against the json module."""

from __future__ import annotations

import json
import random

import pytest

from partloom.sources import json_blocks, parts_files


def objects(spark, path, block=None):
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        rows = json_blocks.read_objects(spark, path).collect()
        return sorted((json.loads(r.value) for r in rows), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


NAMES = ["plain", "a}b", 'say "}" twice }}', "back\\\\slash\\", "},{", "é\n}", "", "x" * 90 + "}"]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("block", [61, 400, 10_000_000])
def test_any_cut_gives_the_same_objects(spark, tmp_path, indent, block):
    rng = random.Random(block)
    for i, names in enumerate((NAMES, ["plain", "p2"])):
        rows = [
            {"name": rng.choice(names), "price": rng.choice([1, None]), "rpm": [1, 2]}
            for _ in range(25)
        ]
        (tmp_path / f"{i}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    (tmp_path / "none.json").write_text("[]")
    wanted = [r for i in range(2) for r in json.loads((tmp_path / f"{i}.json").read_text())]
    assert objects(spark, str(tmp_path), block) == sorted(wanted, key=str)


def test_one_array_is_read_by_many_tasks(spark, tmp_path):
    rows = [{"name": f"part {i}", "size": i, "color": None} for i in range(3000)]
    (tmp_path / "case-fan.json").write_text(json.dumps(rows, separators=(",", ":")))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        fans = parts_files.read_parts_json(spark, str(tmp_path), "case-fan")
        assert fans.rdd.getNumPartitions() > 4
        assert sorted(r["size"][0] for r in fans.select("size").collect()) == [*range(3000)]
        counts = parts_files.count_parts(spark, str(tmp_path)).collect()
        assert [tuple(r) for r in counts] == [("case-fan", "complete", 3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
