"""Repeated byte strings by a logarithmic family of sparse suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier. Strings
are sampled: of each window of ``LENGTH`` bytes the smallest of its ``GRAM``-byte hashes
names the window, so equal windows have equal names wherever they occur. Consecutive
windows of one name form a region. The sparse suffix array of a batch holds one row for
each region: its name, by which it is sorted, a hash of all its bytes, and its place.

The arrays form levels. A new batch is merge-scanned by name with every level, and then
joins them as a binary counter does: levels as large as the new one are merged into it
by the same scan, so a row is rewritten a logarithmic number of times. A name tells all:

* one region content under a name: all its occurrences but the earliest are repeats;
* several contents: these regions are asked for, and their windows are compared one by
  one. Their name needs only one row from then on.

The bytes of the regions that were asked for are dealt by name, so the windows of a name
meet in one task. Where a name has very many regions, their windows are dealt instead,
by window, each task sending only the first of equal ones.

Tasks reduce their own regions before the shuffle to one row a name, so a passage that
a third of all documents hold is one row a task. Text is read once to sample it, once
for the regions that were asked for, and once to cut it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.near_dups import whole_runs
from partloom.llm.storage import (
    release,
    remove,
    shared_path,
    small_batches,
    written,
    written_to,
)
from partloom.llm.words import EXACT, mix, pieces, powers, text_buffers

LENGTH = 100
GRAM = 48
# Windows of one region at most.
REGION = 64
SEGMENT_BYTES = 1 << 18
# Regions or windows that a task reduces at a time, and those of them at full width.
HELD_REGIONS = 2_000_000
PORTION = 1 << 16
# What a task holds of each: narrow, with the number of its text among those held.
HELD = {"name": "i8", "body": "i8", "row": "i4", "start": "i4", "size": "u1", "what": "u1"}
BATCHES = 4
# Regions of one name that are compared in one task at most.
HOT_REGIONS = 5_000

# Kinds of rows: of an index; covered; asked for; of a level that is scanned but stays;
# of an index, with a region that may repeat itself.
INDEXED, COVERED, ASKED, STAYS, LOOPS = 0, 1, 2, 3, 4
FLAG = -1
ROW = "what int, name long, body long, id long, h long, start long, size long"
NO_ID = -(1 << 63)

_BASE_INVERSE = pow(0x5851F42D4C957F2D, -1, 1 << 64)


def _inverse_powers(count: int) -> np.ndarray:
    out = np.full(count, _BASE_INVERSE, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _prefixes(data: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(EXACT[data] * weights[: len(data)], out=out[1:])
    return out


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Stretches (first row, its bytes before, row bounds); those of a long row overlap."""
    rows = len(offsets) - 1
    row = 0
    while row < rows:
        last = int(np.searchsorted(offsets, offsets[row] + SEGMENT_BYTES, "right")) - 1
        if last > row:
            yield row, 0, offsets[row : last + 1]
            row = last
            continue
        start, end = int(offsets[row]), int(offsets[row + 1])
        while True:
            stop = min(start + SEGMENT_BYTES, end)
            yield row, start - int(offsets[row]), np.array([start, stop])
            if stop == end:
                break
            start = stop - LENGTH + 1
        row += 1


class _Sampler:
    def __init__(self):
        self.weights = powers(SEGMENT_BYTES + 1)
        self.inverse = _inverse_powers(SEGMENT_BYTES + 1)

    def regions(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Arrays (name, body, row, start, size, loops) of the regions of a batch."""
        for first, before, bounds in _segments(data, offsets):
            found = self._of(data[bounds[0] : bounds[-1]], bounds - bounds[0])
            if found:
                name, body, row, start, size, loops = found
                yield name, body, row + first, start + before, size, loops

    def _of(self, data: np.ndarray, bounds: np.ndarray):
        count = len(data) - LENGTH + 1
        if count < 1:
            return None
        sums = _prefixes(data, self.weights)
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * self.inverse[: len(sums) - GRAM])
        every = grams
        reach, width = 1, LENGTH - GRAM + 1
        while 2 * reach <= width:
            grams = np.minimum(grams[:-reach], grams[reach:])
            reach *= 2
        names = np.minimum(grams[:count], grams[width - reach : width - reach + count])
        crossing = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(crossing, np.maximum(bounds[1:] - LENGTH + 1, bounds[:-1]), 1)
        np.add.at(crossing, bounds[1:], -1)
        within = np.cumsum(crossing[:-1])[:count] == 0
        opens = within.copy()
        opens[1:] &= ~within[:-1] | (names[1:] != names[:-1])
        start = np.flatnonzero(opens)
        if not len(start):
            return None
        stops = np.flatnonzero(opens | ~within)
        end = np.append(stops, count)[np.searchsorted(stops, start) + 1]
        parts = -(-(end - start) // REGION)
        if parts.max() > 1:
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            start, end = np.repeat(start, parts) + nth * REGION, np.repeat(end, parts)
        size = np.minimum(end - start, REGION)
        body = mix((sums[start + size - 1 + LENGTH] - sums[start]) * self.inverse[start])
        row = np.searchsorted(bounds, start, "right") - 1
        loops = _twice(every, names[start], start, size + width - 1)
        return names[start], body, row, start - bounds[row], size, loops


def _twice(grams: np.ndarray, names: np.ndarray, start: np.ndarray, length: np.ndarray):
    """Whether a region holds its name twice; only then may two of its windows be equal."""
    out = np.zeros(len(start), dtype=bool)
    steps = np.arange(REGION + LENGTH - GRAM)
    for low in range(0, len(start), 4096):
        part = slice(low, low + 4096)
        place = np.minimum(start[part, None] + steps, len(grams) - 1)
        same = (grams[place] == names[part, None]) & (steps < length[part, None])
        out[part] = same.sum(axis=1) > 1
    return out


def _later(id_: np.ndarray, h: np.ndarray, start: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each place comes after the one at ``first``; equal places do not."""
    a, b, c = id_ == id_[first], h == h[first], start > start[first]
    return (id_ > id_[first]) | a & ((h > h[first]) | b & c)


def _table(columns: dict[str, np.ndarray], what: int) -> pa.RecordBatch:
    count = len(columns["name"])
    fields = [pa.array(np.full(count, what, dtype=np.int32))]
    fields += [
        pa.array(columns[c].astype(np.int64, copy=False))
        for c in ("name", "body", "id", "h", "start", "size")
    ]
    return pa.RecordBatch.from_arrays(fields, [f.split()[0] for f in ROW.split(", ")])


def _finding(columns: dict[str, np.ndarray], what: int) -> pa.RecordBatch:
    """Rows that only pass through scans: their place spreads them, body holds the name."""
    place = mix((columns["id"] ^ columns["start"] * 0x9E3779B9).astype(np.uint64))
    return _table(columns | {"name": place.view(np.int64), "body": columns["name"]}, what)


def _merged(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Covered rows of one table; runs of regions that touch become one row each."""
    order = np.lexsort((rows["start"], rows["h"], rows["id"]))
    rows = {k: v[order] for k, v in rows.items()}
    end = rows["start"] + rows["size"]
    breaks = np.ones(len(end), dtype=bool)
    breaks[1:] = (
        (rows["id"][1:] != rows["id"][:-1])
        | (rows["h"][1:] != rows["h"][:-1])
        | (rows["start"][1:] > end[:-1] + LENGTH - 1)
    )
    opens = np.flatnonzero(breaks)
    closes = np.append(opens[1:], len(end)) - 1
    out = {k: v[opens] for k, v in rows.items()}
    out["size"] = end[closes] - out["start"]
    return _finding(out, COVERED)


def _reduced(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Index rows that hold whole names: one row a name, and what is covered or asked for.

    A name of which only rows that stay are here gives no index row.
    """
    order = np.argsort(rows["name"], kind="stable")
    name = rows["name"][order]
    same = np.append(False, name[1:] == name[:-1])
    shared = same | np.append(same[1:], False) | (rows["what"][order] == LOOPS)
    alone = order[~shared & (rows["what"][order] != STAYS)]
    yield _table({k: v[alone] for k, v in rows.items()}, INDEXED)
    rows = {k: v[order[shared]] for k, v in rows.items()}
    if not len(rows["name"]):
        return
    order = np.lexsort((rows["start"], rows["h"], rows["id"], rows["body"], rows["name"]))
    rows = {k: v[order] for k, v in rows.items()}
    new_name = np.append(True, rows["name"][1:] != rows["name"][:-1])
    flag = rows["size"] == FLAG
    new_body = new_name | np.append(True, rows["body"][1:] != rows["body"][:-1])
    of_name = np.cumsum(new_name) - 1
    several = (np.bincount(of_name, new_body) > 1) | (np.bincount(of_name, flag) > 0)
    several |= np.bincount(of_name, rows["what"] == LOOPS) > 0
    several = several[of_name]
    moves = (np.bincount(of_name, rows["what"] != STAYS) > 0)[of_name]
    first = np.flatnonzero(new_body)[np.cumsum(new_body) - 1]
    covered = _later(rows["id"], rows["h"], rows["start"], first) & ~flag
    if covered.any():
        yield _merged({k: v[covered] for k, v in rows.items()})
    kept = new_body & ~several & moves
    yield _table({k: v[kept] for k, v in rows.items()}, INDEXED)
    asked = new_body & several & ~flag
    yield _finding({k: v[asked] for k, v in rows.items()}, ASKED)
    marks = {k: v[several & new_name & moves].copy() for k, v in rows.items()}
    for k in ("body", "id", "h", "start"):
        marks[k][:] = 0
    marks["size"][:] = FLAG
    yield _table(marks, INDEXED)


def _firsts(rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The first row of each content under a name, and the numbers of rows that come later."""
    order = np.lexsort((rows["start"], rows["h"], rows["id"], rows["body"], rows["name"]))
    rows = {k: v[order] for k, v in rows.items()}
    new = np.ones(len(order), dtype=bool)
    new[1:] = (rows["name"][1:] != rows["name"][:-1]) | (rows["body"][1:] != rows["body"][:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    covered = _later(rows["id"], rows["h"], rows["start"], first)
    return {k: v[new] for k, v in rows.items()}, order[covered]


def _portions(keys: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Row numbers by ascending key, about ``most`` at a time; no key is split."""
    order = np.argsort(keys, kind="stable")
    low = 0
    while low < len(order):
        last = keys[order[min(low + most, len(order)) - 1]]
        high = int(np.searchsorted(keys, last, "right", sorter=order))
        yield order[low:high]
        low = high


class _Held:
    """Regions or windows of a task in the order they were added, that of its texts."""

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.count = self.before = self.texts = 0
        self.parts: dict[str, list[np.ndarray]] = {k: [] for k in HELD}
        self.places: dict[str, list[np.ndarray]] = {"id": [], "h": []}

    def add_texts(self, ids: np.ndarray, hs: np.ndarray) -> None:
        """Texts; ``row`` of what is added next is counted from the first of them."""
        self.before, self.texts = self.texts, self.texts + len(ids)
        self.places["id"].append(ids)
        self.places["h"].append(hs)

    def add(self, columns: dict[str, np.ndarray]) -> None:
        columns = columns | {"row": columns["row"] + self.before}
        for k, kind in HELD.items():
            self.parts[k].append(columns[k].astype(kind))
        self.count += len(columns["name"])

    def reduced(self, key: str) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        """First ones of equal content, whole values of ``key`` together, then the covered.

        Nothing is held afterwards. What is covered comes in the order it was added, so
        that runs of it can still be merged.
        """
        places = {k: np.concatenate(v) for k, v in self.places.items()}
        rows = {k: np.concatenate(self.parts.pop(k)) for k in HELD}
        self._clear()

        def wide(at: np.ndarray) -> dict[str, np.ndarray]:
            text = rows["row"][at]
            out = {k: rows[k][at].astype(np.int64) for k in HELD if k != "row"}
            return out | {k: v[text] for k, v in places.items()}

        covered = np.zeros(len(rows["name"]), dtype=bool)
        for portion in _portions(rows[key], PORTION):
            firsts, later = _firsts(wide(portion))
            covered[portion[later]] = True
            yield INDEXED, firsts
        at = np.flatnonzero(covered)
        for low in range(0, len(at), PORTION):
            yield COVERED, wide(at[low : low + PORTION])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h, text) to the index, covered and asked rows of this task."""
    sampler = _Sampler()
    held = _Held()

    def flushed() -> Iterator[pa.RecordBatch]:
        for what, rows in held.reduced("name"):
            if what == COVERED:
                yield _merged(rows)
            else:
                yield from _reduced(rows)

    for whole in batches:
        for batch in pieces(whole, "text"):
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            hs = batch.column("h").to_numpy(zero_copy_only=False)
            held.add_texts(ids, hs)
            data, offsets = text_buffers(batch.column("text"))
            for name, body, row, start, size, loops in sampler.regions(data, offsets):
                what = np.where(loops, LOOPS, INDEXED)
                keys = {"name": name.view(np.int64), "body": body.view(np.int64)}
                held.add(keys | {"row": row, "start": start, "size": size, "what": what})
            if held.count > HELD_REGIONS:
                yield from flushed()
    if held.count:
        yield from flushed()


def _columns(table: pa.Table | pa.RecordBatch) -> dict[str, np.ndarray]:
    return {
        c: table.column(c).to_numpy()
        for c in ("what", "name", "body", "id", "h", "start", "size")
    }


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch and of levels, sorted by name, to their merged index and findings."""
    for rows in whole_runs(batches, "name"):
        what = rows.column("what").to_numpy()
        found = (what == COVERED) | (what == ASKED)
        yield from rows.filter(pa.array(found)).combine_chunks().to_batches()
        rows = rows.filter(pa.array(~found))
        if rows.num_rows:
            yield from _reduced(_columns(rows))


class SuffixFamily:
    """Levels of sparse suffix arrays in a shared folder, and what they have found."""

    def __init__(self):
        # Each level with its number of batches and its folder, the largest first.
        self.levels: list[tuple[int, DataFrame, str]] = []
        self.findings: list[DataFrame] = []

    def add(self, texts: DataFrame, last: bool = False) -> None:
        """Scan a batch of rows (id, h, text) against all levels and make it a level.

        Levels of its own size are merged into it, then those of the size that gives;
        their rows are removed once it is written. The index is not kept after the
        ``last`` batch.
        """
        spark = texts.sparkSession
        rows = texts.mapInArrow(_sampled, ROW)
        size, merged = 1, []
        while self.levels and self.levels[-1][0] == size:
            _, level, folder = self.levels.pop()
            rows = rows.unionByName(level)
            merged.append(folder)
            size *= 2
        for _, level, _ in self.levels:
            rows = rows.unionByName(level.withColumn("what", F.lit(STAYS)))
        dealt = rows.repartition("name").sortWithinPartitions("name").mapInArrow(_scanned, ROW)
        if last:
            dealt = dealt.where(F.col("what") != INDEXED)
        path = shared_path(spark, "level")
        with small_batches(spark):
            found = written_to(path, dealt, by="what", codec="zstd")
        for folder in merged:
            remove(spark, f"{folder}/what={INDEXED}")
        release(spark)
        self.levels.append((size, found.where(F.col("what") == INDEXED), path))
        self.findings.append(found.where(F.col("what").isin(COVERED, ASKED)))

    def found(self, what: int) -> DataFrame:
        """All covered rows, or all that were asked for."""
        every = self.findings[0]
        for more in self.findings[1:]:
            every = every.unionByName(more)
        return every.where(F.col("what") == what)


def _windows(rows: dict[str, np.ndarray], place: np.ndarray, data: np.ndarray):
    """The windows of regions as rows; ``place`` has the first byte of each in ``data``."""
    reach = REGION + LENGTH - 1
    weights, inverse = powers(reach), _inverse_powers(REGION)
    found = []
    for low in range(0, len(place), 4096):
        part = slice(low, low + 4096)
        at = np.minimum(place[part, None] + np.arange(reach), len(data) - 1)
        sums = np.zeros((len(at), reach + 1), dtype=np.uint64)
        np.cumsum(EXACT[data[at]] * weights, axis=1, out=sums[:, 1:])
        hashes = mix((sums[:, LENGTH:] - sums[:, :REGION]) * inverse)
        nth, step = np.nonzero(np.arange(REGION) < rows["size"][part, None])
        found.append(
            {k: rows[k][part][nth] for k in rows.keys() - {"body", "start", "size"}}
            | {"body": hashes[nth, step].view(np.int64), "start": rows["start"][part][nth] + step}
        )
    out = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
    return out | {"size": np.ones(len(out["name"]), dtype=np.int64)}


def _asked_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h, text, asked) to the regions with their bytes; of hot names, to windows."""
    held = _Held()

    def flushed() -> Iterator[pa.RecordBatch]:
        for what, rows in held.reduced("body"):
            batch = _merged(rows) if what == COVERED else _table(rows, INDEXED)
            yield batch.append_column("bytes", pa.nulls(batch.num_rows, pa.binary()))

    for whole in batches:
        for batch in pieces(whole, "text"):
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            hs = batch.column("h").to_numpy(zero_copy_only=False)
            held.add_texts(ids, hs)
            data, offsets = text_buffers(batch.column("text"))
            asked = batch.column("asked")
            flat = asked.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            rows = {
                f: flat.field(f).to_numpy(zero_copy_only=False) for f in ("name", "start", "size")
            }
            rows |= {"id": ids[row], "h": hs[row], "body": np.zeros(len(row), dtype=np.int64)}
            place = offsets[row] + rows["start"]
            hot = flat.field("hot").to_numpy(zero_copy_only=False).astype(bool)
            cold = _table({k: v[~hot] for k, v in rows.items()}, ASKED)
            ends = place[~hot] + rows["size"][~hot] - 1 + LENGTH
            strings = [data[a:b].tobytes() for a, b in zip(place[~hot], ends)]
            yield cold.append_column("bytes", pa.array(strings, pa.binary()))
            rows |= {"row": row, "what": np.full(len(row), INDEXED)}
            at = np.flatnonzero(hot)
            for low in range(0, len(at), PORTION // REGION):
                part = at[low : low + PORTION // REGION]
                held.add(_windows({k: v[part] for k, v in rows.items()}, place[part], data))
            if held.count > HELD_REGIONS:
                yield from flushed()
    if held.count:
        yield from flushed()


def _compared_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions with their bytes, sorted by name, to the covered windows."""
    for table in whole_runs(batches, "name"):
        strings = table.column("bytes").cast(pa.large_binary()).combine_chunks()
        offsets = np.frombuffer(strings.buffers()[1], dtype=np.int64)
        place = offsets[strings.offset : strings.offset + len(strings)]
        data = np.frombuffer(strings.buffers()[2], dtype=np.uint8)
        rows = _columns(table)
        for portion in _portions(rows["name"], PORTION // REGION):
            part = {k: v[portion] for k, v in rows.items()}
            yield from _only_covered(_windows(part, place[portion], data))


def _only_covered(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """All but the first of equal windows."""
    later = _firsts(rows)[1]
    if len(later):
        yield _merged({k: v[later] for k, v in rows.items()})


def _compared_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First windows of all tasks, sorted by body, to the covered ones."""
    for table in whole_runs(batches, "body"):
        yield from _only_covered(_columns(table))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) to the counts and the hash of what is left."""
    for whole in batches:
        for batch in pieces(whole, "text"):
            data, offsets = text_buffers(batch.column("text"))
            removed, counts, digests = [], [], []
            for row, spans in enumerate(batch.column("spans").to_pylist()):
                raw = data[offsets[row] : offsets[row + 1]]
                left = hashlib.sha256()
                at = gone = runs = 0
                for start, end in merged_spans(spans or ()):
                    left.update(raw[at:start])
                    gone, runs, at = gone + end - start, runs + 1, end
                left.update(raw[at:])
                removed.append(gone)
                counts.append(runs)
                digests.append(left.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets)),
                    pa.array(removed, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )


def merged_spans(spans) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of the bytes that ``spans`` cover."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _keyed(documents: DataFrame) -> DataFrame:
    """Rows (id, h, doc_id, text); h tells apart rows of one id with different texts."""
    ids = F.col("doc_id").cast("long")
    twice = documents.groupBy(ids.alias("id")).count().where("count > 1")
    h = F.lit(0).cast("long") if twice.isEmpty() else F.xxhash64("text")
    return documents.select(
        F.coalesce(ids, F.lit(NO_ID)).alias("id"),
        h.alias("h"),
        ids.alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _batches(keyed: DataFrame, count: int) -> Iterator[DataFrame]:
    """The rows in ``count`` parts of about equal size, by ranges of id."""
    shares = [i / count for i in range(1, count)]
    cuts = keyed.agg(F.percentile_approx("id", shares, 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = keyed
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where((F.col("doc_id") <= high) | F.col("doc_id").isNull())
        yield part.select("id", "h", "text")


def repeated_spans(documents: DataFrame, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """The keyed rows of ``documents``, and rows (id, h, spans) of covered byte ranges."""
    keyed = _keyed(documents)
    family = SuffixFamily()
    parts = list(_batches(keyed, batches))
    for part in parts:
        family.add(part, last=part is parts[-1])
    covered = family.found(COVERED)
    asked = family.found(ASKED).withColumn("name", F.col("body"))
    hot = asked.groupBy("name").count().where(F.col("count") > HOT_REGIONS)
    marked = asked.join(hot.select("name", F.lit(True).alias("hot")), "name", "left")
    per_row = marked.groupBy("id", "h").agg(
        F.collect_set(
            F.struct("name", "start", "size", F.coalesce("hot", F.lit(False)).alias("hot"))
        ).alias("asked")
    )
    wanted = keyed.select("id", "h", "text").join(per_row.hint("merge"), ["id", "h"])
    with small_batches(documents.sparkSession):
        regions = written(
            wanted.mapInArrow(_asked_regions, f"{ROW}, bytes binary"), "regions", by="what"
        )
    release(documents.sparkSession)
    cold = regions.where(F.col("what") == ASKED).repartition("name").sortWithinPartitions("name")
    firsts = regions.where(F.col("what") == INDEXED).repartition("body")
    every = (
        covered.unionByName(regions.where(F.col("what") == COVERED).drop("bytes"))
        .unionByName(cold.mapInArrow(_compared_regions, ROW))
        .unionByName(
            firsts.drop("bytes").sortWithinPartitions("body").mapInArrow(_compared_windows, ROW)
        )
    )
    span = F.struct("start", (F.col("start") + F.col("size") - 1 + LENGTH).alias("end"))
    return keyed, every.groupBy("id", "h").agg(F.collect_list(span).alias("spans"))


def without_repeats(documents: DataFrame, batches: int = BATCHES) -> DataFrame:
    """What is left of each text once repeated byte strings are cut out.

    ``documents`` needs doc_id and text, read as UTF-8 bytes. A byte goes if a string of
    100 bytes that covers it also starts earlier: in a row with a smaller doc_id, or
    further up in the same text; strings are judged on the input. Returned: doc_id,
    n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256.

    Null and empty texts have no bytes; a text below 100 bytes stays whole. A null doc_id
    comes before all others. Rows of one doc_id with different texts are ordered by a
    hash of the text; equal rows are one document and get the same result each. Other
    columns are ignored.
    """
    keyed, spans = repeated_spans(documents, batches)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return (
        keyed.join(spans.hint("merge"), ["id", "h"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, schema)
    )
