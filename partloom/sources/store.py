"""Catalogue tables on files, loaded in commits.

A load writes only its new rows, each table to a folder of its own run. The
rows count from the moment one commit record appears; without it a later
reader does not see them, and :meth:`CatalogStore.vacuum` removes them. Beside the rows of
a table that is looked up by key lies a sidecar of its keys, so a small load reads only
the runs that may hold one of its own.
"""

from __future__ import annotations

import logging
import time
import uuid
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from partloom.operators.merge import product_key
from partloom.schemas import TABLE_DDL
from partloom.sources.commit_log import Commit, CommitLog, TableStats
from partloom.sources.key_index import chunks_for, runs_that_may_hold, write_index

log = logging.getLogger(__name__)

# More keys than these are not looked up in sidecars; all runs are read.
LOOKUP_KEYS = 100_000
# Runs without a commit are left alone for so many seconds: they may still be loading.
VACUUM_AGE = 7 * 24 * 3600


class CatalogStore:
    """Tables below one root folder on any file system Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._log = CommitLog(spark, self.root)
        self._commits = self._log.read()
        self._pending: dict[str, dict[str, TableStats]] = {}
        self._indexer = ThreadPoolExecutor(len(INDEX_KEYS))
        self._indexing: dict[str, list[Future]] = {}

    def _runs(self, version: int | None = None) -> list[Commit]:
        """The commits whose rows make up a version, from its last compaction on."""
        commits = self._commits[:version]
        whole = [i for i, commit in enumerate(commits) if commit.whole]
        return commits[whole[-1] if whole else 0 :]

    def refresh(self) -> int:
        """Take notice of loads committed since; returns the latest version."""
        self._commits += self._log.read(self.version)
        return self.version

    @property
    def version(self) -> int:
        return len(self._commits)

    def _rows_of(self, table: str, commits: list[Commit], pending: str | None) -> DataFrame:
        runs = [c.run for c in commits]
        if pending:
            runs.append(pending)
        if not runs:
            return self.spark.createDataFrame([], TABLE_DDL[table])
        paths = [f"{self.root}/{run}/{table}" for run in runs]
        return self.spark.read.schema(TABLE_DDL[table]).parquet(*paths)

    def read(self, table: str, version: int | None = None, pending: str | None = None) -> DataFrame:
        """A table as of a committed version, the latest by default."""
        return self._rows_of(table, self._runs(version), pending)

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        return {table: self.read(table, version) for table in LOADED_TABLES}

    def holding(self, table: str, keys: DataFrame, pending: str | None = None) -> DataFrame:
        """Rows of a table, with all rows of the given keys among them.

        ``keys`` has the columns that the table's key is made of. Runs whose sidecar tells
        that they hold none of the keys are not read. The rows of other keys may come too.
        """
        commits = self._runs()
        filled = [c for c in commits if c.tables is None or c.tables[table].rows]
        told = [c for c in filled if c.tables and c.tables[table].chunks]
        few = keys.limit(LOOKUP_KEYS + 1).count() <= LOOKUP_KEYS if len(told) > 1 else False
        if few:
            sidecars = [(self._index(c.run, table), c.tables[table].chunks) for c in told]
            found = runs_that_may_hold(self.spark, keys, INDEX_KEYS[table](), sidecars)
            hit = {told[i].run for i in found}
            filled = [c for c in filled if c.run in hit or c not in told]
        return self._rows_of(table, filled, pending)

    def highest(self, table: str) -> int | DataFrame:
        """The highest id of a table, or its rows where a commit does not tell."""
        commits = self._runs()
        if any(c.tables is None for c in commits):
            return self.read(table)
        return max((c.tables[table].highest or 0 for c in commits), default=0)

    def _index(self, run: str, table: str) -> str:
        return f"{self.root}/{run}/{table}-keys"

    def begin(self) -> str:
        """Name of a new run on top of the present version, unseen until it commits."""
        run = f"run-{self.refresh():08d}-{uuid.uuid4().hex}"
        self._pending[run] = {}
        return run

    def append(self, run: str, table: str, rows: DataFrame) -> int:
        """Write the new rows of a table, sorted so that scans for a key skip data.

        Returns their number, counted as they are written.
        """
        path = f"{self.root}/{run}/{table}"
        first = rows.columns[0]
        seen = Observation(f"{run}/{table}")
        counted = rows.sortWithinPartitions(SORT_KEYS[table]).observe(
            seen, F.count(F.lit(1)).alias("rows"), F.max(first).alias("highest")
        )
        counted.write.mode("errorifexists").parquet(path)
        count, highest = seen.get["rows"], seen.get["highest"]
        chunks = 0
        if count and table in INDEX_KEYS:
            chunks = chunks_for(count)
            written = self.spark.read.schema(TABLE_DDL[table]).parquet(path)
            place = self._index(run, table)
            # Nothing needs the sidecar before the commit, which waits for it.
            job = self._indexer.submit(write_index, written, INDEX_KEYS[table](), chunks, place)
            self._indexing.setdefault(run, []).append(job)
        self._pending.setdefault(run, {})[table] = TableStats(count, highest, chunks)
        log.info("%s: %d new rows", table, count)
        return count

    def commit(self, run: str, whole: bool = False) -> int:
        """Make a run visible: one record, in place as a whole under its version's name.

        A run that did not see the latest version may hold rows that are there by now,
        so it is refused; so is the slower of two that commit at once.
        """
        for job in self._indexing.pop(run, []):
            job.result()
        version = self.refresh()
        if int(run.split("-")[1]) != version:
            raise RuntimeError(f"another load has committed version {version}")
        tables = self._pending.get(run, {})
        told = tables if set(tables) >= set(LOADED_TABLES) else None
        commit = Commit(version + 1, run, whole, told)
        self._log.append(commit, lambda: self._commits)
        self._commits.append(commit)
        return version + 1

    def vacuum(self, older_than: float = VACUUM_AGE) -> list[str]:
        """Delete runs that were never committed, and drafts of records; returns the runs.

        Only what nothing was written to for ``older_than`` seconds goes, as a load that
        is still running has no record either.
        """
        self.refresh()
        committed = {c.run for c in self._commits}
        files = self._log._fs
        before = (time.time() - older_than) * 1000
        gone = []
        for status in files.listStatus(self._log._path("")):
            name = status.getPath().getName()
            if name.startswith("run-") and name not in committed:
                parts = [status, *files.listStatus(status.getPath())]
                inner = [f for p in parts[1:] for f in files.listStatus(p.getPath())]
                if max(p.getModificationTime() for p in [*parts, *inner]) <= before:
                    files.delete(status.getPath(), True)
                    gone.append(name)
        for path, written in self._log.drafts():
            if written <= before:
                files.delete(path, False)
        return gone

    def compact(self) -> int:
        """Write every table as one run and switch to it in one commit.

        Readers list one folder a table from then on; earlier versions stay readable.
        """
        run = self.begin()
        for table in LOADED_TABLES:
            self.append(run, table, self.read(table))
        return self.commit(run, whole=True)


# Tables a load fills, in the order their keys need, and what each is sorted by.
SORT_KEYS = {
    "manufacturer": "nume",
    "category": "nume",
    "standard": "grup",
    "warehouse": "nume",
    "product": "cod_sku",
    "product_standard": "produs_id",
    "stock": "produs_id",
}
LOADED_TABLES = tuple(SORT_KEYS)

# What the keys of a table's sidecar are made of.
INDEX_KEYS = {
    "product": lambda: product_key(F.col("cod_sku"), F.col("denumire")),
    "product_standard": lambda: F.col("produs_id"),
    "stock": lambda: F.col("produs_id"),
}
