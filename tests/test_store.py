"""A store that outlives broken commits and reads no more than a load needs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from partloom.plans import star_load
from partloom.schemas import TABLE_DDL
from partloom.sources import commit_log, key_index
from partloom.sources.store import LOADED_TABLES, CatalogStore
from tests.test_load import ROWS, wide


def loads(spark, root, count, each=3):
    """A store with so many committed runs of a few products, links and stock rows."""
    store = CatalogStore(spark, root)
    for n in range(count):
        run = store.begin()
        first = store.highest("product") + 1
        ids = range(first, first + each)
        products = [(i, f"s{n}-{i - first}", "name", 1, 1, 24, "ACTIV") for i in ids]
        rows = {
            "category": [(1, "CPU", None)] if n == 0 else [],
            "manufacturer": [(1, "Acme", None, None)] if n == 0 else [],
            "warehouse": [(1, "Central", None, "RO")] if n == 0 else [],
            "standard": [(n + 1, "SOCKET_CPU", f"AM{n}", None)],
            "product": products,
            "product_standard": [(i, n + 1) for i in ids],
            "stock": [(i, 1, 10, 2) for i in ids],
        }
        for table in LOADED_TABLES:
            frame = spark.createDataFrame(rows[table], TABLE_DDL[table]).coalesce(1)
            store.append(run, table, frame)
        store.commit(run)
    return store


def test_a_writer_that_dies_leaves_no_half_commit(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    dying = CatalogStore(spark, root)

    def killed(self, draft, final):
        raise KeyboardInterrupt  # the draft is written, the record not in place

    monkeypatch.setattr(commit_log.CommitLog, "_rename", killed)
    with pytest.raises(KeyboardInterrupt):
        star_load.load(dying, wide(spark, ROWS[:1]))
    monkeypatch.undo()
    assert CatalogStore(spark, root).version == 0
    report = star_load.load(CatalogStore(spark, root), wide(spark, ROWS))
    assert report.version == 1 and report.added["product"] == 4


def test_an_empty_record_blocks_nothing(spark, tmp_path):
    root = tmp_path / "store"
    (root / "_commits").mkdir(parents=True)
    (root / "_commits" / "00000001.json").write_text("")
    store = CatalogStore(spark, str(root))
    assert store.version == 0
    assert star_load.load(store, wide(spark, ROWS[:1])).version == 1
    assert CatalogStore(spark, str(root)).version == 1


def test_records_without_counts_are_read_whole(spark, tmp_path):
    """Records written before there were sidecars name the run alone."""
    root = tmp_path / "store"
    store = loads(spark, str(root), 2)
    for path in (root / "_commits").glob("0*.json"):
        record = json.loads(path.read_text())
        del record["tables"]
        path.write_text(json.dumps(record) + "\n")
        (root / "_commits" / f".{path.name}.crc").unlink()
    old = CatalogStore(spark, store.root)
    report = star_load.load(old, wide(spark, [("s0-0", "again", "CPU", "Acme", "AM0")]))
    assert report.added["product"] == 0
    report = star_load.load(old, wide(spark, [("new", "new", "CPU", "Acme", "AM0")]))
    assert report.added["product"] == 1
    ids = [r[0] for r in old.read("product").select("produs_id").collect()]
    assert len(ids) == len(set(ids)) == 7


def one_category(spark, i):
    return spark.createDataFrame([(i, f"c{i}", None)], TABLE_DDL["category"])


def test_opening_reads_one_checkpoint_and_its_tail(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commit_log, "CHECKPOINT_EVERY", 3)
    store = CatalogStore(spark, str(tmp_path / "store"))
    for i in range(8):
        run = store.begin()
        for table in LOADED_TABLES:
            frame = spark.createDataFrame([], TABLE_DDL[table])
            store.append(run, table, frame if table != "category" else one_category(spark, i))
        store.commit(run)
    files = [f.rsplit("/", 2)[-2:] for f in commit_log.CommitLog(spark, store.root).files()]
    assert files == [
        ["_checkpoints", "00000006.json"],
        ["_commits", "00000007.json"],
        ["_commits", "00000008.json"],
    ]
    again = CatalogStore(spark, store.root)
    assert again.version == 8 and again.read("category").count() == 8
    assert again.read("category", version=4).count() == 4
    assert again.highest("category") == 7


def test_vacuum_removes_what_was_never_committed(spark, tmp_path):
    root = tmp_path / "store"
    store = loads(spark, str(root), 1)
    run = store.begin()
    store.append(run, "category", store.read("category"))
    (root / "_commits" / ".left.draft").write_text("{")
    assert store.vacuum() == [] and (root / run).exists()  # it may still be running
    assert store.vacuum(older_than=-1) == [run]
    assert not (root / run).exists() and not (root / "_commits" / ".left.draft").exists()
    assert store.read("product").count() == 3


def test_a_small_load_reads_only_runs_that_may_hold_its_keys(spark, tmp_path):
    store = loads(spark, str(tmp_path / "store"), 5)

    def runs(rows):
        return {f.split("/run-")[1][:8] for f in rows.inputFiles()}

    keys = spark.createDataFrame([("s4-1", "x")], "cod_sku string, denumire string")
    assert len(runs(store.read("product"))) == 5
    assert runs(store.holding("product", keys)) == {"00000004"}
    unknown = spark.createDataFrame([("none", "x")], "cod_sku string, denumire string")
    assert runs(store.holding("product", unknown)) == set()
    held = store.read("product").where("cod_sku IN ('s1-0', 's3-2')").select("produs_id")
    assert runs(store.holding("stock", held)) == {"00000001", "00000003"}
    assert store.highest("product") == store.read("product").agg(F.max("produs_id")).first()[0]
    rows = [("s4-1", "later", "GPU", "B", "AM1"), ("t", "new", "GPU", "B", "AM1")]
    looked = []
    reads = store._rows_of
    store._rows_of = lambda table, commits, pending: (
        looked.append((table, len(commits))) or reads(table, commits, pending)
    )
    report = star_load.load(store, wide(spark, rows))
    assert report.added["product"] == 1 and report.added["stock"] == 1
    assert report.added["product_standard"] == 2  # the known product has a further socket
    ids = [r[0] for r in store.read("product").select("produs_id").collect()]
    assert len(ids) == len(set(ids)) == 16
    # Of the five runs with products, links and stock one is read for each.
    assert {n for table, n in looked[:-1] if table in ("product", "product_standard", "stock")} == {1}


def test_sidecars_never_miss_a_key(spark, tmp_path):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"))
    path = str(tmp_path / "keys")
    chunks = key_index.chunks_for(20_000)
    key_index.write_index(keys, F.col("k"), chunks, path)
    assert chunks == spark.read.parquet(path).count() == 10
    other = str(tmp_path / "other")
    key_index.write_index(keys.limit(1), F.lit("z"), 1, other)
    find = lambda rows: key_index.runs_that_may_hold(
        spark, rows, F.col("k"), [(path, chunks), (other, 1)]
    )
    assert find(keys.sample(0.001, 1)) == [0]
    absent = spark.range(2000).select(F.concat(F.lit("a"), "id").alias("k"))
    wrong = sum(find(absent.where(F.col("k") == f"a{i}")) != [] for i in range(10))
    assert wrong <= 2
    assert find(absent.limit(0)) == []


def test_counts_come_from_the_write(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path / "store"))
    run = store.begin()
    assert store.append(run, "category", store.read("category")) == 0
    rows = spark.range(70, numPartitions=5).selectExpr("id AS categorie_id", "'n' AS nume", "'' AS descriere")
    run = store.begin()
    assert store.append(run, "category", rows) == 70
    assert set(store._pending[run]) == {"category"} <= set(LOADED_TABLES)
    assert store._pending[run]["category"].highest == 69
