"""Prefix tries of conversations from sorted sequences and their common prefixes.

Conversations are sorted over the cluster as sequences of turn hashes, so those that start
alike stand in a row. A task takes its rows in blocks. Of a block, the lengths of the
prefixes that neighbours share go into a sparse table, whose level k holds the least of
each 2**k neighbouring lengths. Every prefix then searches both ways, by halving steps, for
the last neighbour with which it is still shared; nothing but the table is looked at, so
all prefixes of a block are searched at once. Prefixes that reach the edge of their block
may go on in the next one: their counts are added up by the prefix's hash. There are no
more of them than turns in the first and the last conversation of each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.expressions import WORD
from partloom.llm.storage import written
from partloom.operators.joins import lookup

# Turns of a block; a conversation is never split.
BLOCK_TURNS = 1 << 19
# Ids that are hashed at a time for a prefix at which many conversations end.
CHUNK_IDS = 256

NONE_END = hashlib.sha256(b"").hexdigest()
FOUND = pa.schema(
    [
        ("kind", pa.string()),
        *[
            (name, pa.int64())
            for name in (
                "conv_id",
                "depth",
                "parent_conv_id",
                "n_convs",
                "n_children",
                "n_leaves",
                "saved_tokens",
                "n_words",
            )
        ],
        ("ends_sha256", pa.string()),
        ("prefix", pa.binary()),
        ("parent_prefix", pa.binary()),
        ("part", pa.int32()),
        ("place", pa.int64()),
        ("ids", pa.string()),
    ]
)
FOUND_DDL = (
    "kind string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, n_words long, ends_sha256 string, prefix binary, "
    "parent_prefix binary, part int, place long, ids string"
)
COUNTS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
RESULT = ["conv_id", "depth", "parent_conv_id", *COUNTS, "ends_sha256"]


def sequences(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turns): each conversation's turns in order, as hash and words.

    Turns are ordered by turn (null first), equal ones by hash. Null role or text counts
    as empty. Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.sha2(content, 256).alias("hash"),
        F.regexp_count(text, F.lit(WORD)).cast("int").alias("n_words"),
    )
    return (
        conversations.where("conv_id IS NOT NULL")
        .select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("t")).alias("turns"))
        .withColumn(
            "turns", F.transform("turns", lambda t: F.struct(t["hash"].alias("hash"), t["n_words"].alias("n_words")))
        )
    )


def regrafted(rows: DataFrame, every: int = 20, choices: int = 4) -> DataFrame:
    """Sequences whose first turns are those of the conversation they branch off from.

    Conversation c takes its first h turns (0 to ``choices`` - 1, by a checksum of c) from
    conversation c - c % ``every``: all that one has if they are fewer, none if it does not exist.
    """
    rows = written(rows, "sequences")
    base = F.col("conv_id") - F.col("conv_id") % every
    stems = rows.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, max(choices - 1, 1)).alias("stem")
    )
    kept = (F.crc32(F.col("conv_id").cast("string")) % choices).cast("int")

    def cut(turns: Column, start: Column | int, size: Column) -> Column:
        return F.slice(turns, start, F.greatest(size, F.lit(0)))

    stem = F.when(F.col("stem").isNotNull(), cut(F.col("stem"), F.lit(1), kept))
    own = cut(F.col("turns"), kept + 1, F.size("turns") - kept)
    return (
        rows.withColumn("base", base)
        .join(stems, "base", "left")
        .select("conv_id", F.when(stem.isNull(), own).otherwise(F.concat(stem, own)).alias("turns"))
    )


class Block:
    """Conversations sorted by their turns, and the nodes of their trie.

    Nodes are listed by the conversation that has them first, then by depth, so the
    subtree of a node is a run of that list.
    """

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, keys: np.ndarray, words: np.ndarray):
        self.ids, self.bounds, self.keys = ids, bounds, keys
        self.sizes = np.diff(bounds)
        n = len(ids)
        self.shared = _levels(self._common())
        owner = np.repeat(np.arange(n), self.sizes)
        depth = np.arange(len(owner)) - np.repeat(bounds[:-1], self.sizes) + 1
        left = self._left(owner, depth)
        first = np.flatnonzero(left == owner)
        number = np.cumsum(left == owner) - 1
        self.left, self.depth = owner[first], depth[first]
        self.right = self._right(self.left, self.depth)
        self.words = words[first]
        self.n_convs = self.right - self.left + 1
        self.least = _least(_levels(ids), self.left, self.right)
        # The node of each turn, found at the conversation that has its prefix first.
        node = number[bounds[left] + depth - 1]
        self.parent = np.where(self.depth > 1, node[first - 1], -1)
        below = self.parent[self.parent >= 0]
        self.n_children = np.bincount(below, minlength=len(first))
        last = node[bounds[1:][self.sizes > 0] - 1]
        self.n_ends = np.bincount(last, minlength=len(first))
        end = np.searchsorted(self.left, self.right, "right")
        self.n_leaves = _between(self.n_children == 0, end)
        self.saved = _between((self.n_convs - 1) * self.words, end)
        self.open = (self.left == 0) | (self.right == n - 1)

    def _common(self) -> np.ndarray:
        """For each conversation the number of turns it shares with the one before."""
        least = np.minimum(self.sizes[1:], self.sizes[:-1])
        row = np.repeat(np.arange(len(least)), least)
        turn = np.arange(len(row)) - np.repeat(np.cumsum(least) - least, least)
        unlike = self.keys[self.bounds[row] + turn] != self.keys[self.bounds[row + 1] + turn]
        unlike = np.flatnonzero(unlike.any(axis=1))
        np.minimum.at(least, row[unlike], turn[unlike])
        return np.concatenate(([0], least))

    def _left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first conversation of the row around ``at`` that shares so many turns."""
        at = at.copy()
        for k in reversed(range(len(self.shared))):
            back = at - (1 << k)
            fits = np.flatnonzero(back >= 0)
            fits = fits[self.shared[k][back[fits] + 1] >= depth[fits]]
            at[fits] = back[fits]
        return at

    def _right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last conversation of the row around ``at`` that shares so many turns."""
        at = at.copy()
        for k in reversed(range(len(self.shared))):
            fits = np.flatnonzero(at + (1 << k) < len(self.ids))
            fits = fits[self.shared[k][at[fits] + 1] >= depth[fits]]
            at[fits] += 1 << k
        return at

    def closed_nodes(self) -> dict[str, np.ndarray | list]:
        """Nodes that lie within the block. Of a parent that does not, the prefix is given."""
        at = np.flatnonzero(~self.open)
        parent = self.parent[at]
        known = (parent >= 0) & ~self.open[parent]
        prefixes = self._prefixes()
        ends = [NONE_END] * len(at)
        for i in np.flatnonzero(self.n_ends[at] > 0).tolist():
            start = int(self.left[at[i]])
            ids = self.ids[start : start + int(self.n_ends[at[i]])]
            ends[i] = hashlib.sha256(_joined(ids).encode()).hexdigest()
        return {
            "kind": ["node"] * len(at),
            "conv_id": self.least[at],
            "depth": self.depth[at],
            "parent_conv_id": pa.array(self.least[parent], mask=~known)
            if len(at)
            else pa.array([], pa.int64()),
            "n_convs": self.n_convs[at],
            "n_children": self.n_children[at],
            "n_leaves": self.n_leaves[at],
            "saved_tokens": self.saved[at],
            "ends_sha256": ends,
            "parent_prefix": [
                None if ok else prefixes[p] for ok, p in zip(known.tolist(), parent.tolist())
            ],
        }

    def open_nodes(self) -> dict[str, np.ndarray | list]:
        """Nodes that may go on in other blocks, the root first, without those below them.

        Children are counted, and leaves and savings summed, over the closed ones only.
        """
        at = np.concatenate(([-1], np.flatnonzero(self.open)))
        place = np.full(len(self.open) + 1, -1)  # the root, -1, is the last of them
        place[at] = np.arange(len(at))
        inner = np.flatnonzero(~self.open)
        inner = inner[(self.parent[inner] < 0) | self.open[self.parent[inner]]]
        above = place[self.parent[inner]]
        children, leaves, saved = (np.zeros(len(at), dtype=np.int64) for _ in range(3))
        np.add.at(children, above, 1)
        np.add.at(leaves, above, self.n_leaves[inner])
        np.add.at(saved, above, self.saved[inner])
        own, prefixes = at[1:], self._prefixes()
        with_root = lambda root, values: np.concatenate(([root], values[own]))
        return {
            "kind": ["open"] * len(at),
            "conv_id": with_root(self.ids.min(), self.least),
            "depth": with_root(0, self.depth),
            "n_convs": with_root(len(self.ids), self.n_convs),
            "n_children": children,
            "n_leaves": leaves,
            "saved_tokens": saved,
            "n_words": with_root(0, self.words),
            "prefix": [prefixes[i] for i in at.tolist()],
            "parent_prefix": [None, *[prefixes[i] for i in self.parent[own].tolist()]],
        }

    def open_ends(self, part: int, block: int) -> dict[str, list]:
        """The ids of conversations that end at open nodes, in order, a chunk a row."""
        prefixes = self._prefixes()
        runs = [(-1, 0, int((self.sizes == 0).sum()))]
        at = np.flatnonzero(self.open & (self.n_ends > 0))
        runs += [*zip(at.tolist(), self.left[at].tolist(), self.n_ends[at].tolist())]
        chunks = [
            (prefixes[node], (block << 32) + i, _joined(self.ids[i : min(i + CHUNK_IDS, start + size)]))
            for node, start, size in runs
            for i in range(start, start + size, CHUNK_IDS)
        ]
        return {
            "kind": ["ends"] * len(chunks),
            "prefix": [c[0] for c in chunks],
            "part": [part] * len(chunks),
            "place": [c[1] for c in chunks],
            "ids": [c[2] for c in chunks],
        }

    def _prefixes(self) -> dict[int, bytes]:
        """Hashes of the turns that lead to each open node; the root is -1."""
        if not hasattr(self, "_hashed"):
            found = {-1: hashlib.sha256(b"").digest()}
            for edge in {0, len(self.ids) - 1}:
                digest = hashlib.sha256()
                turns = self.keys[self.bounds[edge] : self.bounds[edge + 1]]
                hashes = []
                for turn in turns:
                    digest.update(turn.tobytes())
                    hashes.append(digest.digest())
                if edge == 0:
                    mine = np.flatnonzero(self.left == 0)
                else:
                    mine = np.flatnonzero(self.right == edge)
                for i in mine.tolist():
                    found[i] = hashes[self.depth[i] - 1]
            self._hashed = found
        return self._hashed


def _levels(values: np.ndarray) -> list[np.ndarray]:
    """A sparse table: level k holds the least of 2**k neighbours from each place on."""
    levels = [values]
    while len(levels[-1]) > 1 << (len(levels) - 1):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    return levels


def _least(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least value of each range, both ends included, from two runs that cover it."""
    out = np.zeros(len(left), dtype=np.int64)
    sizes = right - left + 1
    for k, level in enumerate(levels):
        mine = np.flatnonzero((sizes >= 1 << k) & (sizes < 2 << k))
        out[mine] = np.minimum(level[left[mine]], level[right[mine] - (1 << k) + 1])
    return out


def _between(values: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of the values from each place to its end."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[end] - sums[: len(end)]


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _blocks(batches: Iterator[pa.RecordBatch], turns: int) -> Iterator[tuple[int, Block]]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.list_value_length(batch.column("n_words"))).as_py() or 0
        if size >= turns:
            yield _block(held)
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield _block(held)


def _block(batches: list[pa.RecordBatch]) -> tuple[int, Block]:
    """The number of the task's range and its next conversations."""
    table = pa.Table.from_batches(batches)
    words, sizes, keys = [], [], []
    for batch in batches:
        lists = batch.column("n_words")
        words.append(lists.flatten().to_numpy(zero_copy_only=False))
        sizes.append(np.diff(lists.offsets.to_numpy()))
        keys.append(b"".join(batch.column("path").to_pylist()))
    bounds = np.concatenate(([0], np.cumsum(np.concatenate(sizes), dtype=np.int64)))
    keys = np.frombuffer(b"".join(keys) or bytes(16), dtype=np.uint64).reshape(-1, 2)
    ids = table.column("conv_id").to_numpy()
    block = Block(ids, bounds, keys, np.concatenate(words).astype(np.int64))
    return table.column("part")[0].as_py(), block


def _rows(columns: dict) -> pa.RecordBatch:
    size = len(columns["kind"])
    arrays = [
        pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type)
        for f in FOUND
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=FOUND)


def _tries(turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (part, block) in enumerate(_blocks(batches, turns)):
            yield _rows(block.closed_nodes())
            yield _rows(block.open_nodes())
            yield _rows(block.open_ends(part, number))

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of the ids at each prefix, from chunks sorted by prefix and place."""
    current, digest = None, None

    def row() -> pa.RecordBatch:
        arrays = [pa.array([current], pa.binary()), pa.array([digest.hexdigest()])]
        return pa.RecordBatch.from_arrays(arrays, ["prefix", "ends_sha256"])

    for batch in batches:
        for prefix, ids in zip(
            batch.column("prefix").to_pylist(), batch.column("ids").to_pylist()
        ):
            if prefix != current:
                if current is not None:
                    yield row()
                current, digest = prefix, hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
    if current is not None:
        yield row()


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open nodes with what lies below them, from the deepest up."""
    rows = [row for batch in batches for row in batch.to_pylist()]
    rows.sort(key=lambda r: -r["depth"])
    by_prefix = {r["prefix"]: r for r in rows}
    for row in rows:
        row["n_leaves"] += row["n_children"] == 0
        row["saved_tokens"] += (row["n_convs"] - 1) * row["n_words"]
        above = by_prefix.get(row["parent_prefix"])
        if above is not None:
            above["n_children"] += 1
            above["n_leaves"] += row["n_leaves"]
            above["saved_tokens"] += row["saved_tokens"]
            row["parent_conv_id"] = above["conv_id"]
    fields = [(name, pa.int64()) for name in ("conv_id", "depth", "parent_conv_id", *COUNTS)]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("prefix", pa.binary()), *fields]))


def trie(rows: DataFrame, block_turns: int | None = None) -> DataFrame:
    """The nodes of the prefix trie of sequences as :func:`sequences` gives them.

    A node is a distinct sequence of the first ``depth`` turns of any conversation; the
    root, depth 0, has no turn. Conversations that start with it are its members. Returned
    for each node, as long but for the last: conv_id (its smallest member), depth,
    parent_conv_id (the parent's conv_id, null for the root), n_convs (members),
    n_children, n_leaves (childless nodes in its subtree), saved_tokens (over its
    subtree, members but one times the words of the node's last turn) and ends_sha256
    (hash of the ids of the conversations that end there, ascending, joined by commas).

    Conversations without turns are members of the root alone. Without any conversation
    there is no node. Turns are told apart by 128 bits of a hash. A conversation is
    held by one task as 20 bytes a turn.
    """
    spark = rows.sparkSession
    hashes = F.transform("turns", lambda t: F.substring(t["hash"], 1, 32))
    paths = written(
        rows.select(
            "conv_id",
            F.unhex(F.array_join(hashes, "")).alias("path"),
            F.transform("turns", lambda t: t["n_words"]).alias("n_words"),
        ),
        "paths",
    )
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_paths = (
        paths.repartitionByRange(ranges, "path", "conv_id")
        .sortWithinPartitions("path", "conv_id")
        .withColumn("part", F.spark_partition_id())
    )
    found = written(
        sorted_paths.mapInArrow(_tries(block_turns or BLOCK_TURNS), FOUND_DDL), "trie", "kind"
    )
    pieces = (
        found.where("kind = 'open'")
        .groupBy("prefix")
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.max("depth").alias("depth"),
            F.max("n_words").alias("n_words"),
            F.max("parent_prefix").alias("parent_prefix"),
            *[F.sum(c).alias(c) for c in COUNTS],
        )
    )
    longs = ", ".join(f"{c} long" for c in ("conv_id", "depth", "parent_conv_id", *COUNTS))
    # The turns at the edges of blocks, a few conversations in each half million turns.
    opened = written(pieces.repartition(1).mapInArrow(_totals, f"prefix binary, {longs}"), "open")
    ends = (
        found.where("kind = 'ends'")
        .select("prefix", "part", "place", "ids")
        .repartition("prefix")
        .sortWithinPartitions("prefix", "part", "place")
        .mapInArrow(_hashed, "prefix binary, ends_sha256 string")
    )
    edge = opened.join(ends, "prefix", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NONE_END))
    )
    parents = opened.select(F.col("prefix").alias("parent_prefix"), F.col("conv_id").alias("above"))
    inner = lookup(found.where("kind = 'node'"), parents, ["parent_prefix"]).withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "above")
    )
    return inner.select(*RESULT).unionByName(edge.select(*RESULT))
