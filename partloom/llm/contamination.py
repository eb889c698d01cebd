"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every word sequence that occurs in a benchmark item. Words of
a document stream through it; the state tracks the longest match that ends at each
word, so every window of an item is found where it ends, with the items it is from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.storage import written
from partloom.llm.words import FOLDED, LETTERS, hash_words, mix, pieces, row_bounds, text_buffers

# Benchmark words that one automaton holds; more are split over several passes.
BLOCK_WORDS = 2_000_000

RESULT = (
    "n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>"
)


class Automaton:
    """All word sequences of a set of items, up to ``width`` words long windows."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], width: int):
        self.width = width
        items = [(name, words) for name, words in items if len(words)]
        flat = [words for _, words in items] or [np.zeros(0, dtype=np.uint64)]
        self.vocabulary = np.unique(np.concatenate(flat))
        self.shortest = min((min(len(w), width) for _, w in items), default=width)
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [(name, np.searchsorted(self.vocabulary, w).tolist()) for name, w in items]
        pairs = set()
        for _, word in coded:
            last = 0
            for c in word:
                last = self._extend(last, c)
            pairs.update(zip(word[:-1], word[1:]))
        self.pairs = np.sort(
            np.array([a * len(self.vocabulary) + b for a, b in pairs], dtype=np.int64)
        )
        self.items: list[set[str]] = [set() for _ in self.next]
        self.short: list[list[tuple[int, str | None]]] = [[] for _ in self.next]
        for number, (name, word) in enumerate(coded):
            self._mark(name, word)
        self.above = self._nearest_short()

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, c: int) -> int:
        """The state for ``state`` followed by ``c``, which exists, at exactly one word more."""
        target = self.next[state][c]
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state >= 0 and self.next[state].get(c) == target:
            self.next[state][c] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        added = self._new(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and c not in self.next[state]:
            self.next[state][c] = added
            state = self.link[state]
        if state >= 0:
            self.link[added] = self._split(state, c)
        return added

    def _mark(self, name: str | None, word: list[int]) -> None:
        """Note the item at the states of its windows."""
        state, length = 0, 0
        for c in word:
            state, length = self._step(state, length, c)
            if length >= self.width and name is not None:
                self.items[self._window(state)].add(name)
        if len(word) < self.width:
            self.short[state].append((len(word), name))

    def _step(self, state: int, length: int, c: int) -> tuple[int, int]:
        edges = self.next[state]
        while state and c not in edges:
            state = self.link[state]
            length = self.length[state]
            edges = self.next[state]
        return (edges[c], length + 1) if c in edges else (0, 0)

    def _window(self, state: int) -> int:
        """The state that holds the last ``width`` words of a match."""
        while self.length[self.link[state]] >= self.width:
            state = self.link[state]
        return state

    def _nearest_short(self) -> list[int]:
        """For each state itself or the nearest linked state at which a short item ends."""
        above = [-1] * len(self.next)
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            link = self.link[state]
            above[state] = state if self.short[state] else (above[link] if link >= 0 else -1)
        return above

    def scan(self, codes: list[int], hit: np.ndarray, items: set[str]) -> None:
        """Mark the words of ``codes`` that lie in a window, and add the items they are from."""
        state, length = 0, 0
        for i, c in enumerate(codes):
            state, length = self._step(state, length, c)
            if length >= self.width:
                hit[i - self.width + 1 : i + 1] = True
                items |= self.items[self._window(state)]
            at = self.above[state]
            while at >= 0:
                for size, name in self.short[at]:
                    if size <= length:
                        hit[i - size + 1 : i + 1] = True
                        if name is not None:
                            items.add(name)
                link = self.link[at]
                at = self.above[link] if link >= 0 else -1

    def stretches(self, hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Where a window may lie: runs of words whose neighbours are neighbours in an item."""
        if not len(hashes) or not len(self.vocabulary):
            return
        codes = np.searchsorted(self.vocabulary, hashes)
        codes[codes == len(self.vocabulary)] = 0
        known = self.vocabulary[codes] == hashes
        joined = known[:-1] & known[1:] & (rows[:-1] == rows[1:])
        at = np.flatnonzero(joined)
        keys = codes[at] * len(self.vocabulary) + codes[at + 1]
        if len(self.pairs):
            place = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            joined[at] = self.pairs[place] == keys
        else:
            joined[:] = False
        breaks = np.concatenate(([0], np.flatnonzero(~joined) + 1, [len(hashes)]))
        sizes = np.diff(breaks)
        for i in np.flatnonzero((sizes >= self.shortest) & known[breaks[:-1]]):
            yield int(breaks[i]), codes[breaks[i] : breaks[i + 1]].tolist()


def _automata(benchmark: DataFrame, width: int) -> Iterator[Automaton]:
    """Automata over all items, each of at most about ``BLOCK_WORDS`` words."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(
        "text IS NOT NULL"
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (4 * BLOCK_WORDS)))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for number in range(blocks):
        rows = items.where(block == number).toArrow()
        data, offsets = text_buffers(rows.column("text"))
        hashes, owners, *_ = hash_words(data, offsets, LETTERS, FOLDED)
        bounds = row_bounds(owners, rows.num_rows)
        names = rows.column("item_id").to_pylist()
        yield Automaton(
            [(names[i], hashes[bounds[i] : bounds[i + 1]]) for i in range(len(names))], width
        )


def _matches(shared, text_at: int, fields: pa.Schema):
    """Adds what one automaton finds to what earlier ones found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for whole in batches:
            for batch in pieces(whole, whole.schema.names[text_at]):
                data, offsets = text_buffers(batch.column(text_at))
                hashes, rows, heads, sizes = hash_words(data, offsets, LETTERS, FOLDED)
                bounds = row_bounds(rows, batch.num_rows)
                hit = np.zeros(len(hashes), dtype=bool)
                before = batch.column("spans").to_pylist()
                items = [set(x or ()) for x in batch.column("items").to_pylist()]
                for start, codes in automaton.stretches(hashes, rows):
                    automaton.scan(
                        codes, hit[start : start + len(codes)], items[int(rows[start])]
                    )
                for row, spans in enumerate(before):
                    for span in spans or ():
                        inside = slice(bounds[row], bounds[row + 1])
                        near = heads[inside] - offsets[row]
                        hit[inside] |= (near >= span["start"]) & (near < span["end"])
                goes_on = hit[:-1] & hit[1:] & (rows[1:] == rows[:-1])
                opens = np.flatnonzero(hit & ~np.append(False, goes_on)[: len(hit)])
                closes = np.flatnonzero(hit & ~np.append(goes_on, False)[: len(hit)])
                spans: list[list[dict]] = [[] for _ in items]
                for a, b in zip(opens, closes):
                    row = int(rows[a])
                    spans[row].append(
                        {
                            "start": int(heads[a] - offsets[row]),
                            "end": int(heads[b] + sizes[b] - offsets[row]),
                        }
                    )
                counted = np.concatenate(([0], np.cumsum(hit)))[bounds]
                found = {
                    "n_words": pa.array(np.diff(bounds)),
                    "n_hit": pa.array(np.diff(counted)),
                    "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    "spans": pa.array(spans, fields.field("spans").type),
                }
                yield pa.RecordBatch.from_arrays(
                    [found.get(n, c) for n, c in zip(batch.schema.names, batch.columns)],
                    batch.schema.names,
                )

    return run


_SPANS = pa.schema(
    [("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
)


def _found(documents: DataFrame, benchmark: DataFrame, width: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` as k0, k1, ... beside n_words, n_hit, items and spans."""
    state = documents.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
        F.col("text").alias("body"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"),
        F.lit(None).cast("array<string>").alias("items"),
        F.lit(None).cast("array<struct<start: int, end: int>>").alias("spans"),
    )
    context = documents.sparkSession.sparkContext
    for number, automaton in enumerate(_automata(benchmark, width)):
        if number:
            state = written(state, "contamination")
        shared = context.broadcast(automaton)
        state = state.mapInArrow(_matches(shared, len(keep), _SPANS), state.schema)
    return state


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """What of each document occurs in a benchmark item.

    Words are runs of [0-9a-z] and non-ASCII characters, A-Z lower-cased. A window is
    ``width`` consecutive words of an item, or a whole shorter item. A word of a
    document is hit if it lies in any occurrence of a window.

    Returned: doc_id, n_words, n_hit, items (sorted ids of the items with occurring
    windows) and spans (byte ranges of maximal hit runs). Null or empty text: no words.
    Items without words have no window; an item whose id is null marks words but is not
    listed; an empty benchmark marks nothing. Repeated documents are returned as often
    as they come; other columns are ignored.
    """
    found = _found(documents, benchmark, width, ["doc_id"])
    return found.select(F.col("k0").alias("doc_id"), "n_words", "n_hit", "items", "spans")


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, width: int = 10, max_coverage: float = 0.5
) -> DataFrame:
    """The documents without their benchmark passages.

    Every hit run, as :func:`contamination` finds them, is cut out of the text. A
    document of whose words more than ``max_coverage`` are hit goes as a whole. All
    other rows and all columns stay as they are; an n_chars column is counted anew
    for the rows that change.
    """
    names = documents.columns
    found = _found(documents, benchmark, width, names).where(
        F.col("n_hit") <= max_coverage * F.col("n_words")
    )
    raw = F.encode("body", "UTF-8")
    gaps = F.transform(
        F.sequence(F.lit(0), F.size("spans")),
        lambda i: F.struct(
            F.when(i == 0, 0).otherwise(F.get(F.col("spans"), i - 1)["end"]).alias("a"),
            F.coalesce(F.get(F.col("spans"), i)["start"], F.octet_length("body")).alias("b"),
        ),
    )
    cut = F.array_join(
        F.transform(gaps, lambda g: F.decode(F.substring(raw, g["a"] + 1, g["b"] - g["a"]), "UTF-8")),
        "",
    )
    changed = F.col("n_hit") > 0
    out = found.withColumn("left", F.when(changed, cut).otherwise(F.col("body")))
    columns = {c: F.col(f"k{i}") for i, c in enumerate(names)}
    columns["text"] = F.col("left")
    if "n_chars" in columns:
        length = F.length("left").cast(documents.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(changed, length).otherwise(columns["n_chars"])
    return out.select(*[column.alias(c) for c, column in columns.items()])
