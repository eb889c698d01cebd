"""Near-duplicate documents by a chosen-path set similarity join.

Each document is the set of its word shingles. A tree starts with all documents
in one node. A node that is too large to compare exhaustively branches: it picks
minwise tokens by a hash of its own path (the root a few, deeper nodes one, so that no
level has more rows than the one above) and sends every document to
the child named by its token there, so similar documents keep meeting while
others part. Nodes that have become small are compared exhaustively, and links
are confirmed on the full sets. Independent trees repeat this until a similar
pair has met in one of them almost surely.

Documents with the same set are collapsed first. Small nodes with the same
members in several trees are compared once, and a confirmed node yields only the
links that join its members, never all its pairs. The trees come in rounds: a node
whose members the rounds before have put into one component has nothing to add and
is not looked at again. A node that is still large
after the last level holds documents that are nearly all alike; its members are
first dealt to blocks that share a few members of the node, and the blocks are
compared like any small node, other blocks in every tree. What these links leave in
several components within a large node is joined exactly: two similar sets share one
of their rarest shingles, so all members that have such a shingle in common and are
not in one component meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.components import members, stars
from partloom.llm.storage import Steps
from partloom.llm.words import (
    FOLDED,
    NOT_SPACE,
    hash_words,
    mix,
    numbered,
    pieces,
    shingle_hashes,
    text_buffers,
)

TOKENS = 64
# Trees of each round.
ROUNDS = (4, 12)
LEVELS = 4
# A node is compared exhaustively up to so many documents and shingles; a node that stays
# larger, in blocks of about so many documents and shingles, with so many shared members.
LEAF = 1024
BLOCK = 2048
SHINGLES = 4_000_000
PIVOTS = 8
# Shingles are ordered by the counts of so many buckets; any order gives the same pairs.
BUCKETS = 1 << 18
# Bits that tell, before texts are shuffled, which may be wanted; set bits of others only cost time.
MARKS = 1 << 24
# Estimates from 64 tokens stray by 0.05 at most similarities; four times that is allowed.
SLACK = 0.2

SET_SCHEMA = "doc_id long, n_shingles long, key_a long, key_b long, tokens binary, sketch binary"


def _sets(width: int):
    multipliers = (numbered(7, TOKENS) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)

    def tokens(parts: list[np.ndarray]) -> np.ndarray:
        """The minwise tokens of non-empty sets, a row each."""
        flat = (np.concatenate(parts) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        out = np.empty((len(parts), TOKENS), dtype=np.uint32)
        for i, m in enumerate(multipliers):
            out[:, i] = np.minimum.reduceat(flat * m, starts)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                data, offsets = text_buffers(batch.column("text"))
                hashes, rows, *_ = hash_words(data, offsets, NOT_SPACE, FOLDED)
                sets = list(shingle_hashes(hashes, rows, batch.num_rows, width))
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(sizes)
                packed: list[bytes | None] = [None] * len(sets)
                sketch: list[bytes | None] = [None] * len(sets)
                keys = np.zeros((2, len(sets)), dtype=np.uint64)
                if len(full):
                    for row, line in zip(full, tokens([sets[i] for i in full])):
                        packed[row] = line.tobytes()
                        # A byte of each token: others agree in one of 256, which links nothing.
                        sketch[row] = line.astype(np.uint8).tobytes()
                        # Order-free sums over the set name it in 128 bits.
                        keys[0, row] = sets[row].sum(dtype=np.uint64)
                        keys[1, row] = mix(sets[row] + np.uint64(1)).sum(dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()),
                        pa.array(sizes),
                        pa.array(keys[0].view(np.int64)),
                        pa.array(keys[1].view(np.int64)),
                        pa.array(packed, pa.binary()),
                        pa.array(sketch, pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "key_a", "key_b", "tokens", "sketch"],
                )

    return run


def _token_matrix(column: pa.Array, kind: type = np.uint32) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype=kind).reshape(len(column), TOKENS)


def _branch(level: int, threshold: float, roots: np.ndarray):
    """Rows (node, doc_id, tokens) to the children of each node; level 0 starts at the roots."""
    chance = 1.0 / (threshold * TOKENS) if level == 0 else 0.0
    seeds = numbered(1000 + level, TOKENS)

    def children(nodes: np.ndarray) -> np.ndarray:
        """Which tokens each node picks, by its path alone: one at least."""
        draw = mix(nodes[:, None] ^ seeds[None, :])
        picked = draw < np.uint64(int(chance * 2**64))
        picked[np.arange(len(nodes)), draw.argmin(axis=1)] = True
        return picked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picked = children(roots)
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                matrix = _token_matrix(batch.column("tokens"))
                if level == 0:
                    tree, token = np.nonzero(picked)
                    row = np.repeat(np.arange(len(matrix)), len(tree))
                    parent = np.tile(roots[tree], len(matrix))
                    token = np.tile(token, len(matrix))
                else:
                    above = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
                    row, token = np.nonzero(children(above))
                    parent = above[row]
                path = parent * numbered(3, 1)[0] + mix(
                    (token.astype(np.uint64) << np.uint64(32)) | matrix[row, token]
                )
                at = pa.array(row)
                kept = [batch.column(c).take(at) for c in ("doc_id", "component", "n_shingles")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix(path).view(np.int64)), *kept],
                    ["node", "doc_id", "component", "n_shingles"],
                )

    return run


def whole_runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables in which every run of equal ``column`` values of the sorted input is whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], "left"))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        elif held and held[-1].column(column)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _likely_groups(floor: float):
    """Small nodes to groups of members whose estimated similarity reaches ``floor``.

    All pairs of a node are compared but those that are in one group already. Members of
    one component are from the start, and groups of one component are left out.
    """

    def groups_of(nodes: np.ndarray, component: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        group = np.unique(np.stack([nodes, component]), axis=1, return_inverse=True)[1].reshape(-1)
        for step in range(1, len(nodes)):
            at = np.flatnonzero(nodes[step:] == nodes[:-step])
            if not len(at):
                break
            at = at[group[at] != group[at + step]]
            for low in range(0, len(at), 65536):
                part = at[low : low + 65536]
                same = (matrix[part] == matrix[part + step]).sum(axis=1)
                for i in part[same >= floor * TOKENS]:
                    if group[i] != group[i + step]:
                        group[group == group[i + step]] = group[i]
        return group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "node"):
            docs = table.column("doc_id").to_numpy()
            matrix = _token_matrix(table.column("sketch").combine_chunks(), np.uint8)
            component = table.column("component").to_numpy()
            group = groups_of(table.column("node").to_numpy(), component, matrix)
            order = np.lexsort((docs, group))
            cuts = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
            names, out, of = [], [], []
            for low, high in zip(cuts[:-1], cuts[1:]):
                part = order[low:high]
                if (component[part] != component[part[0]]).any():
                    ids, first = np.unique(docs[part], return_index=True)
                    spread = mix(ids.view(np.uint64) + np.uint64(5))
                    name = mix(np.array([spread.sum(dtype=np.uint64)]))[0]
                    names.append(np.full(len(ids), name))
                    out.append(ids)
                    of.append(component[part[first]])
            if out:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(names).view(np.int64)),
                        pa.array(np.concatenate(out)),
                        pa.array(np.concatenate(of)),
                    ],
                    ["node", "doc_id", "component"],
                )

    return run


def _confirmed(width: int, percent: int):
    """Links that join the members of each group, confirmed on full shingle sets."""

    def links(
        docs: np.ndarray, known: np.ndarray, sets: list[np.ndarray]
    ) -> Iterator[tuple[int, int]]:
        """Each member meets all others at once, unless all are in its component already."""
        full = [i for i, s in enumerate(sets) if len(s)]
        docs, known, sets = docs[full], known[full], [sets[i] for i in full]
        sizes = np.array([len(s) for s in sets])
        starts = np.cumsum(sizes) - sizes
        shingles = np.unique(np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), return_inverse=True)[1]
        component = np.unique(known, return_inverse=True)[1]
        marked = np.zeros(len(shingles), dtype=bool)
        for i, (start, size) in enumerate(zip(starts, sizes)):
            alike = (100 * size >= percent * sizes) & (100 * sizes >= percent * size)
            if not (alike & (component != component[i])).any():
                continue
            own = shingles[start : start + size]
            marked[own] = True
            both = np.add.reduceat(marked[shingles].astype(np.int32), starts)
            marked[own] = False
            near = 100 * both >= percent * (size + sizes - both)
            for j in np.flatnonzero(near & (component != component[i])):
                if component[i] != component[j]:
                    component[component == component[j]] = component[i]
                    yield int(docs[i]), int(docs[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "node"):
            nodes = table.column("node").to_numpy()
            docs = table.column("doc_id").to_numpy()
            known = table.column("component").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1], [True])))
            found: list[tuple[int, int]] = []
            for low, high in zip(cuts[:-1], cuts[1:]):
                text = table.column("text").slice(low, high - low)
                data, offsets = text_buffers(text)
                hashes, rows, *_ = hash_words(data, offsets, NOT_SPACE, FOLDED)
                sets = list(shingle_hashes(hashes, rows, high - low, width))
                found += links(docs[low:high], known[low:high], sets)
            if found:
                a, b = np.array(found, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _shingle_sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    data, offsets = text_buffers(batch.column("text"))
    hashes, rows, *_ = hash_words(data, offsets, NOT_SPACE, FOLDED)
    return list(shingle_hashes(hashes, rows, batch.num_rows, width))


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(BUCKETS)).astype(np.int64)


def _bucket_counts(width: int):
    """How many sets have a shingle of each bucket, task by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for whole in batches:
            for batch in pieces(whole, "text"):
                flat = np.concatenate([np.zeros(0, np.uint64), *_shingle_sets(batch, width)])
                counts += np.bincount(_bucket(flat), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used])], ["bucket", "n"]
        )

    return run


def _prefixes(width: int, percent: int, shared):
    """The rarest shingles of each set: of two linked sets, one at least is in both's.

    A shingle alone in its bucket is in no other set and is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for whole in batches:
            for batch in pieces(whole, "text"):
                sets = _shingle_sets(batch, width)
                rare = []
                for s in sets:
                    # Linked sets share percent of the larger one, so of either one.
                    length = len(s) + 1 - -(-percent * len(s) // 100) if len(s) else 0
                    first = s[np.lexsort((s, counts[_bucket(s)]))[:length]]
                    rare.append(first[counts[_bucket(first)] > 1])
                row = np.repeat(np.arange(len(sets)), [len(r) for r in rare])
                flat = np.concatenate([np.zeros(0, np.uint64), *rare])
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(flat.view(np.int64)),
                        batch.column("doc_id").take(pa.array(row)),
                        batch.column("component").take(pa.array(row)),
                        pa.array(sizes[row]),
                    ],
                    ["shingle", "doc_id", "component", "n_shingles"],
                )

    return run


def _meetings(bodies: DataFrame, width: int, percent: int, steps: Steps) -> DataFrame:
    """Rows (node, doc_id): blocks in which all documents meet that have a rare shingle in common.

    ``bodies`` has doc_id, text and component. Documents of the largest component of a
    shingle meet all others; they need not meet each other. Both sides are cut into
    blocks, and every pair of blocks is a node.
    """
    counted = (
        bodies.mapInArrow(_bucket_counts(width), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    )
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for r in counted.collect():
        counts[r.bucket] = r.n
    shared = bodies.sparkSession.sparkContext.broadcast(counts)
    rare = steps.write(
        bodies.mapInArrow(
            _prefixes(width, percent, shared),
            "shingle long, doc_id long, component long, n_shingles long",
        ),
        "rare",
    )
    whole = F.struct(F.col("n").alias("n"), F.col("weight").alias("weight"), "component")
    lists = (
        rare.groupBy("shingle", "component")
        .agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
        .groupBy("shingle")
        .agg(F.max(whole).alias("main"), F.sum("n").alias("size"), F.sum("weight").alias("weight"))
        .where("size > main.n")
    )

    def parts(size: F.Column, weight: F.Column) -> F.Column:
        return F.greatest(F.ceil(size / BLOCK), F.ceil(weight / SHINGLES)).cast("long")

    lists = lists.select(
        "shingle",
        F.col("main.component").alias("main"),
        parts(F.col("size"), F.col("weight")).alias("rows"),
        parts(F.col("size") - F.col("main.n"), F.col("weight") - F.col("main.weight")).alias("columns"),
    )
    met = rare.join(lists, "shingle")
    own_row = F.pmod(F.xxhash64("shingle", "doc_id"), F.col("rows"))
    own_column = F.pmod(F.xxhash64("doc_id", "shingle"), F.col("columns"))
    one = met.select(
        "shingle", "doc_id", own_row.alias("r"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("c")
    )
    other = met.where("component <> main").select(
        "shingle", "doc_id", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), own_column.alias("c")
    )
    node = F.xxhash64("shingle", "r", "c").alias("node")
    return one.select(node, "doc_id").unionByName(other.select(node, "doc_id")).distinct()


def _apart(large: DataFrame, reached: DataFrame) -> DataFrame:
    """Rows (doc_id, component): the members of large nodes that are in several components."""
    named = _with_component(large.select("node", "doc_id"), reached)
    return named.join(_several(named), "node").select("doc_id", "component").distinct()


def _with_component(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with the component of each document, which is its own where it has no link."""
    reached = known.select(F.col("id").alias("doc_id"), "component")
    return rows.join(reached, "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id")
    )


def _several(named: DataFrame) -> DataFrame:
    """The nodes with members of more than one component."""
    return (
        named.groupBy("node")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("node")
    )


def _unlike(nodes: DataFrame) -> DataFrame:
    """``nodes`` without those that have the same members as another, or one member only."""
    like = ["n", "low", "high", "own_a", "own_b"]
    # One shuffle for the reduction and the join; a node is small or a block, so no task is large.
    nodes = nodes.repartition("node")
    told = nodes.groupBy("node").agg(
        F.count("*").alias("n"),
        F.min("doc_id").alias("low"),
        F.max("doc_id").alias("high"),
        F.bit_xor(F.xxhash64("doc_id")).alias("own_a"),
        F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("own_b"),
    )
    one = told.where("n > 1").groupBy(*like).agg(F.min("node").alias("node"))
    return nodes.join(one.select("node"), "node", "left_semi")


def _marked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``texts`` without most of those that are not ``wanted``, told before any shuffle.

    What is broadcast is a set of bits of fixed size. The more documents are wanted, the
    more others pass, and a join with ``wanted`` has to follow.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    one = F.lit(1).cast("long")
    marks = wanted.groupBy(word.alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", one, bit)).alias("_bits")
    )
    near = texts.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(marks), "_word")
    kept = near.where(F.getbit("_bits", F.col("_bit")) == 1)
    return kept.select(*texts.columns)


def _only(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``texts`` with the columns of ``wanted``, whose doc_id is distinct; marked before the shuffle.

    Never a broadcast: how many documents are wanted grows with the table. Nor a semi join,
    which Spark moves below the marks.
    """
    return _marked(texts, wanted).join(wanted.hint("merge"), "doc_id")


def _links(
    nodes: DataFrame,
    sets: DataFrame,
    texts: DataFrame,
    width: int,
    percent: int,
    steps: Steps,
    name: str,
    done: list[DataFrame],
) -> DataFrame:
    """Links (a, b) that join the similar members of each node.

    ``sets`` has the component of each document so far; links within one are left out, and
    groups with the members of one in ``done`` are not compared again. Adds its own there.
    """
    unlike = steps.write(_unlike(nodes), f"unlike{name}")
    told = sets.select("doc_id", "component", "sketch")
    pairs = unlike.join(told, "doc_id").repartition("node").sortWithinPartitions("node")
    floor = percent / 100 - SLACK
    likely = pairs.mapInArrow(_likely_groups(floor), "node long, doc_id long, component long")
    likely = likely.distinct()
    for before in done:
        likely = likely.join(before.select("node").distinct(), "node", "left_anti")
    likely = steps.write(likely, f"likely{name}")
    done.append(likely)
    del pairs
    steps.drop(f"unlike{name}")
    wanted = likely.select("doc_id").distinct()
    bodies = _only(texts, wanted)
    groups = likely.join(bodies, "doc_id").repartition("node").sortWithinPartitions("node")
    links = steps.write(
        groups.mapInArrow(_confirmed(width, percent), "a long, b long"), f"links{name}"
    )
    return links


def _small_nodes(
    sets: DataFrame, threshold: float, roots: np.ndarray, steps: Steps, name: str
) -> tuple[DataFrame, DataFrame | None]:
    """Rows (node, doc_id) to compare in the trees of ``roots``, and the nodes that stayed large.

    Nodes whose members are all in one component are left out.
    """
    small = None
    above = sets.drop("sketch")
    for level in range(LEVELS):
        rows = steps.write(
            above.mapInArrow(
                _branch(level, threshold, roots),
                "node long, doc_id long, component long, n_shingles long",
            ),
            f"rows{level}{name}",
        )
        sizes = (
            rows.groupBy("node")
            .agg(
                F.count("*").alias("size"),
                F.sum("n_shingles").alias("weight"),
                F.min("component").alias("low"),
                F.max("component").alias("high"),
            )
            .where("low <> high")
            .select("node", "size", "weight")
        )
        sized = steps.write(rows.select("node", "doc_id").join(sizes, "node"), f"nodes{level}{name}")
        del rows, sizes
        steps.drop(f"rows{level}{name}")
        is_small = (F.col("size") <= LEAF) & (F.col("weight") <= SHINGLES)
        leaves = sized.where(is_small).select("node", "doc_id")
        small = leaves if small is None else small.unionByName(leaves)
        large = sized.where(~is_small)
        if large.isEmpty():
            return small, None
        above = large.select("node", "doc_id").join(sets.drop("sketch"), "doc_id")
    return small.unionByName(steps.write(_blocks(large), f"nodes_blocks{name}")), large


def _blocks(large: DataFrame) -> DataFrame:
    """Members of large nodes in blocks; all blocks of a node share some members."""
    parts = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / SHINGLES))
    block = F.xxhash64("node", F.pmod(F.xxhash64("node", "doc_id"), parts))
    dealt = large.select(block.alias("block"), "node", "doc_id")
    shared = [F.min_by("doc_id", F.xxhash64("doc_id", F.lit(i))) for i in range(PIVOTS)]
    pivots = large.groupBy("node").agg(F.array_distinct(F.array(*shared)).alias("shared"))
    pivots = pivots.select("node", F.explode("shared").alias("doc_id"))
    blocks = dealt.select("block", "node").distinct().join(pivots, "node")
    return (
        dealt.select("block", "doc_id")
        .unionByName(blocks.select("block", "doc_id"))
        .distinct()
        .withColumnRenamed("block", "node")
    )


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: its set size, its group, and whether it stays.

    ``documents`` needs doc_id and text. Words are runs of other bytes than ASCII
    white space, A-Z lower-cased; a document is the set of its distinct
    ``width``-word shingles (a shorter one has its whole sequence as one shingle).
    Two documents are linked when 100 * intersection >= percent * union. Returned:
    doc_id, n_shingles, component_id (the smallest doc_id reachable through links,
    itself included), kept (doc_id = component_id).

    Null or blank text: no shingles, linked with nothing. Null doc_id: linked with
    nothing, component_id null, kept. Repeated rows are returned as often as they
    come; rows of one doc_id with different texts count as one document with several
    sets. Other columns are ignored.
    """
    threshold = percent / 100
    steps = Steps(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = steps.write(texts.mapInArrow(_sets(width), SET_SCHEMA), "every")
    full = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = steps.write(full.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("first_id")), "first")
    sets = steps.write(
        full.join(first.withColumnRenamed("first_id", "doc_id"), ["key_a", "key_b", "doc_id"])
        .dropDuplicates(["key_a", "key_b", "doc_id"])
        .select("doc_id", "tokens", "sketch", "n_shingles", F.col("doc_id").alias("component")),
        "sets_0",
    )
    keys = steps.write(every.drop("tokens", "sketch"), "keys")
    steps.drop("every")

    joined, reached, stayed, done = None, None, None, []
    roots = numbered(99, sum(ROUNDS))
    for turn, count in enumerate(ROUNDS):
        start = sum(ROUNDS[:turn])
        if turn:
            sets = steps.write(_with_component(sets.drop("component"), reached), f"sets_{turn}")
            steps.drop(f"sets_{turn - 1}")
        nodes, large = _small_nodes(
            sets, threshold, roots[start : start + count], steps, f"_{turn}"
        )
        found = _links(nodes, sets, texts, width, percent, steps, f"_{turn}", done)
        # Links found later part no component, so without any the components stay.
        if joined is None or not found.isEmpty():
            joined = stars(found if joined is None else joined.unionByName(found))
            reached = members(joined)
        del nodes
        if large is not None:
            large = large.select("node", "doc_id")
            stayed = large if stayed is None else stayed.unionByName(large)
    if stayed is not None:
        apart = steps.write(_apart(stayed, reached), "apart")
        if not apart.isEmpty():
            bodies = steps.write(_only(texts, apart), "apart_texts")
            meetings = _meetings(bodies, width, percent, steps)
            named = _with_component(sets.drop("component"), reached)
            own = bodies.select("doc_id", "text")
            more = _links(meetings, named, own, width, percent, steps, "_apart", done)
            steps.drop("apart_texts", "rare")
            if not more.isEmpty():
                reached = members(stars(joined.unionByName(more)))
        steps.drop("apart")
    steps.drop(*[name for name in steps.paths if name.startswith(("sets", "nodes", "likely"))])

    named = (
        first.join(reached, first.first_id == reached.id, "left")
        .select("key_a", "key_b", F.coalesce("component", "first_id").alias("found"))
    )
    is_full = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    linked = keys.where(is_full).join(named, ["key_a", "key_b"], "left")
    alone = keys.where(~is_full | is_full.isNull()).withColumn("found", F.lit(None).cast("long"))
    return linked.unionByName(alone).select(
        "doc_id",
        "n_shingles",
        F.coalesce("found", "doc_id").alias("component_id"),
        F.coalesce(F.col("found") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
