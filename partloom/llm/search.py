"""Ranked lexical search with the Best Position Algorithm.

Every task turns the documents it reads into impact lists, one for each query term, sorted
by what the term adds to a document's score. Each query reads its lists in parallel. A
document met for the first time is looked up in all other lists (a direct access), which
also tells its positions there. The best position of a list is the one up to which all
have been seen, by reading or by direct access. No unseen document can score more than the
impacts just behind the best positions add up to; a query stops once that sum is strictly
below the score of the last document it keeps. The best of all tasks are ranked at the end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.llm.storage import remove, shared_path, written_to
from partloom.llm.words import FOLDED, LETTERS, hash_words, pieces, row_bounds, text_buffers

TOP = 10
# Bytes of query texts that are searched in one pass over the documents.
PASS_BYTES = 4_000_000
# Postings whose impact lists a task holds at a time.
BLOCK_POSTINGS = 1 << 20
# Positions read from each list between two looks at the stopping rule; doubled each time.
FIRST_READ = 16

POSTINGS = "doc_id long, n_terms long, codes array<int>, counts array<int>"
RANKED = "query long, doc_id long, score long"


@dataclass
class Queries:
    """The queries of a pass, by number: the codes of their terms and how often each comes."""

    vocabulary: np.ndarray
    codes: dict[int, np.ndarray]
    repeats: dict[int, np.ndarray]


def _passes(items: DataFrame) -> Iterator[tuple[DataFrame, Queries]]:
    """Numbered items in passes of about ``PASS_BYTES``, with their terms."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // PASS_BYTES))
    # Numbers are only unique; which query gets which does not matter.
    numbered = items.withColumn("query", F.monotonically_increasing_id())
    numbered = written_to(shared_path(items.sparkSession, "items"), numbered)
    for number in range(count):
        chosen = numbered.where(F.pmod(F.xxhash64("query"), F.lit(count)) == number)
        rows = chosen.select("query", "text").toArrow()
        data, offsets = text_buffers(rows.column("text"))
        hashes, owners, *_ = hash_words(data, offsets, LETTERS, FOLDED)
        bounds = row_bounds(owners, rows.num_rows)
        vocabulary = np.unique(hashes)
        queries = Queries(vocabulary, {}, {})
        for i, name in enumerate(rows.column("query").to_pylist()):
            terms, repeats = np.unique(hashes[bounds[i] : bounds[i + 1]], return_counts=True)
            queries.codes[name] = np.searchsorted(vocabulary, terms)
            queries.repeats[name] = repeats.astype(np.int64)
        yield chosen, queries


def _postings(shared):
    """For each document the query terms it holds, how often, and its number of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for whole in batches:
            for batch in pieces(whole, "text"):
                data, offsets = text_buffers(batch.column("text"))
                hashes, rows, *_ = hash_words(data, offsets, LETTERS, FOLDED)
                bounds = row_bounds(rows, batch.num_rows)
                codes = np.searchsorted(vocabulary, hashes)
                codes[codes == len(vocabulary)] = 0
                known = vocabulary[codes] == hashes if len(vocabulary) else hashes != hashes
                keys = rows[known] * max(len(vocabulary), 1) + codes[known]
                keys, counts = np.unique(keys, return_counts=True)
                owners = keys // max(len(vocabulary), 1)
                starts = pa.array(row_bounds(owners, batch.num_rows).astype(np.int32))
                found = (keys - owners * max(len(vocabulary), 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(starts, pa.array(found)),
                        pa.ListArray.from_arrays(starts, pa.array(counts.astype(np.int32))),
                    ],
                    ["doc_id", "n_terms", "codes", "counts"],
                )

    return run


def weights(frequency: np.ndarray, documents: int) -> np.ndarray:
    """The weight of terms that so many of all documents hold."""
    return np.array(
        [math.floor(1000 * math.log((2 * documents + 2) / (2 * f + 1))) for f in frequency.tolist()],
        dtype=np.int64,
    )


class Lists:
    """Impact lists of a block of documents, and the same postings by document."""

    def __init__(self, documents, lengths, bounds, codes, counts, weight, n_documents, n_terms):
        self.documents = documents
        longness = 25 + (75 * lengths * n_documents) // max(n_terms, 1)
        sizes = np.diff(bounds)
        owners = np.repeat(np.arange(len(documents)), sizes)
        counts = counts.astype(np.int64)
        impacts = weight[codes] * ((1_000_000_000 * counts) // (1000 * counts + 8 * longness[owners]))
        order = np.lexsort((owners, -impacts, codes))
        self.impacts = impacts[order]
        self.owners = owners[order]
        self.lists = np.searchsorted(codes[order], np.arange(len(weight) + 1))
        # By document: the term of each posting, and its place in the impact lists.
        self.bounds = bounds
        self.codes = codes
        self.places = np.empty(len(order), dtype=np.int64)
        self.places[order] = np.arange(len(order))
        self.seen = np.zeros(len(order), dtype=bool)
        self.met = np.zeros(len(documents), dtype=bool)

    def look_up(self, new: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Scores of documents by direct access; their places in the lists count as seen."""
        sizes = self.bounds[new + 1] - self.bounds[new]
        starts = np.cumsum(sizes) - sizes
        postings = np.repeat(self.bounds[new] - starts, sizes) + np.arange(int(sizes.sum()))
        factors = times[self.codes[postings]]
        places = self.places[postings]
        self.seen[places[factors > 0]] = True
        return np.add.reduceat(factors * self.impacts[places], starts)

    def search(self, terms, repeats, times, best: Best) -> None:
        """Offers ``best`` every document that may be among the best for these terms."""
        held = self.lists[terms + 1] > self.lists[terms]
        terms, repeats = terms[held], repeats[held]
        starts, ends = self.lists[terms], self.lists[terms + 1]
        gives = self.impacts[starts] > 0
        terms, repeats, starts, ends = terms[gives], repeats[gives], starts[gives], ends[gives]
        if not len(terms):
            return
        times[terms] = repeats
        position = starts.copy()
        touched = []
        step = FIRST_READ
        while True:
            on = position < ends
            bound = int((repeats[on] * self.impacts[position[on]]).sum())
            if bound <= 0 or bound < best.least():
                break
            read = [self.owners[a : min(a + step, b)] for a, b in zip(position[on], ends[on])]
            new = np.unique(np.concatenate(read))
            new = new[~self.met[new]]
            self.met[new] = True
            touched.append(new)
            best.offer(self.look_up(new, times), self.documents, new)
            for i in np.flatnonzero(on):
                position[i] = self._first_unseen(int(position[i]), int(ends[i]))
            step *= 2
        times[terms] = 0
        for a, b in zip(starts, ends):
            self.seen[a:b] = False
        for new in touched:
            self.met[new] = False

    def _first_unseen(self, place: int, end: int) -> int:
        """The place behind the best position of a list."""
        while place < end:
            run = self.seen[place : min(place + 4096, end)]
            first = int(np.argmin(run))
            if not run[first]:
                return place + first
            place += len(run)
        return end


class Best:
    """The ``top`` highest scores of a query so far, smaller doc_ids first among equals."""

    def __init__(self, top: int):
        self.top = top
        self.scores = np.zeros(0, dtype=np.int64)
        self.documents: list[int | None] = []

    def least(self) -> int:
        """The score that a document must reach to be kept."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def offer(self, scores: np.ndarray, documents: list, chosen: np.ndarray) -> None:
        enough = scores >= max(self.least(), 1)
        if not enough.any():
            return
        scores, chosen = scores[enough], chosen[enough]
        if len(scores) > self.top:  # none below the last of the best of these can stay
            least = np.partition(scores, -self.top)[-self.top]
            chosen, scores = chosen[scores >= least], scores[scores >= least]
        rows = [*zip(self.scores.tolist(), self.documents)]
        rows += [(s, documents[d]) for s, d in zip(scores.tolist(), chosen.tolist())]
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        rows = rows[: self.top]
        self.scores = np.array([r[0] for r in rows], dtype=np.int64)
        self.documents = [r[1] for r in rows]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in blocks of about ``BLOCK_POSTINGS`` postings."""
    held, size = [], 0
    for batch in batches:
        start = 0
        ends = batch.column("codes").offsets.to_numpy()
        while start < batch.num_rows:
            end = int(np.searchsorted(ends, ends[start] + BLOCK_POSTINGS - size, "right")) - 1
            end = min(max(end, start + (not held)), batch.num_rows)
            held.append(batch.slice(start, end - start))
            size += int(ends[end] - ends[start])
            start = end
            if size >= BLOCK_POSTINGS or start < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the bounds of its rows."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy(), bounds - bounds[0]


def _searched(shared, top: int):
    """The best documents of a task for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight, n_documents, n_terms = shared.value
        best = {name: Best(top) for name in queries.codes}
        times = np.zeros(len(weight), dtype=np.int64)
        for block in _blocks(batches):
            codes, bounds = _flat(block.column("codes"))
            counts, _ = _flat(block.column("counts"))
            lists = Lists(
                block.column("doc_id").to_pylist(),
                block.column("n_terms").to_numpy(),
                bounds,
                codes,
                counts,
                weight,
                n_documents,
                n_terms,
            )
            for name, terms in queries.codes.items():
                lists.search(terms, queries.repeats[name], times, best[name])
        rows = [(q, d, int(s)) for q, b in best.items() for s, d in zip(b.scores, b.documents)]
        if rows:
            fields = [pa.array(list(column), pa.int64()) for column in zip(*rows)]
            yield pa.RecordBatch.from_arrays(fields, ["query", "doc_id", "score"])

    return run


def _pass(documents: DataFrame, queries: Queries, top: int) -> tuple[DataFrame, str]:
    """Rows (query, doc_id, score): the best of each task, and the folder that holds them."""
    spark = documents.sparkSession
    context = spark.sparkContext
    vocabulary = context.broadcast(queries.vocabulary)
    folder = shared_path(spark, "postings")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    postings = written_to(folder, texts.mapInArrow(_postings(vocabulary), POSTINGS))
    n_documents, n_terms = postings.where("n_terms > 0").agg(F.count("*"), F.sum("n_terms")).first()
    held = postings.select(F.explode("codes").alias("code")).groupBy("code").count()
    frequency = np.zeros(len(queries.vocabulary), dtype=np.int64)
    for code, count in held.collect():  # a row for each query term at most
        frequency[code] = count
    told = (queries, weights(frequency, n_documents), n_documents, n_terms or 0)
    matching = postings.where(F.size("codes") > 0)
    found = matching.mapInArrow(_searched(context.broadcast(told), top), RANKED)
    best = shared_path(spark, "best")
    rows = written_to(best, found.withColumn("part", F.spark_partition_id()))
    remove(spark, folder)
    return rows, best


def _first_of(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= top)


def ranked(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents for each item, by the words they share.

    Terms are runs of [0-9A-Za-z] and non-ASCII characters, A-Z lower-cased, of whole
    texts; they are told apart by 64-bit hashes. N documents hold a term, all terms number
    L, and n of them are the document's. A term that df documents hold weighs
    floor(1000 * ln((2N + 2) / (2df + 1))), and adds, if it comes tf times, that weight
    times (10^9 * tf) div (1000 * tf + 8 * (25 + (75 * n * N) div L)) to a document's
    score, as often as it comes in the item.

    Returned: item_id, rank (from 1; equal scores by doc_id, null last), doc_id (long) and
    score, for scores above 0. Null or empty texts have no terms: as a document they
    are never found, as an item they find nothing. Rows of ``items`` that share an item_id
    are ranked each for itself, and so are rows of ``documents`` that share a doc_id.
    Empty tables give no rows; other columns are ignored.

    Terms of about ``PASS_BYTES`` of items are held by each task at a time; longer tables
    of items take more passes over the documents.
    """
    spark = documents.sparkSession
    results = []
    for chosen, queries in _passes(items.select("item_id", "text")):
        rows, _ = _pass(documents, queries, top)
        # The best of some tasks first, so that no item gathers a row of every task at once.
        some = _first_of(rows.withColumn("part", F.col("part") % 64), ["query", "part"], top)
        last = _first_of(some.drop("part", "rank"), ["query"], top)
        results.append(chosen.select("query", "item_id").join(last, "query"))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.select("item_id", "rank", "doc_id", "score")
