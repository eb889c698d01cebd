"""Toxicity scores from a factorization machine over hashed terms.

The score of a document is a weight per term plus the inner product of two term
vectors for each pair of its terms, so the machine learns that two terms matter
together where neither does alone. Pairs cost no more than single terms: their sum
is half the squared sum of the vectors less the sum of their squares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from partloom.llm.words import FOLDED, LETTERS, hash_words, mix, pieces, powers, text_buffers

# Words and their beginnings of so many bytes hash to this many slots.
SLOTS = 1 << 30
BEGINNINGS = (4, 5, 6, 7, 8)
FACTORS = 4
# A slot gets a weight if so many training rows have it, and the share of toxic ones
# among them lies so many standard errors from the share among all.
LEAST_ROWS = 4
LEAST_ERRORS = 4.0
# Labelled rows a model is fitted on at most, chosen by a hash of doc_id.
SAMPLE_ROWS = 10_000
EPOCHS = 30
SEED = 11


def _terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every word and word beginning of the texts, repeats included."""
    data, offsets = text_buffers(batch.column("text"))
    hashes, rows, heads, sizes = hash_words(data, offsets, LETTERS, FOLDED)
    found = [(rows, hashes)]
    start = np.zeros(len(heads), dtype=np.uint64)
    weights = powers(max(BEGINNINGS))
    for length in range(1, max(BEGINNINGS) + 1):
        longer = np.flatnonzero(sizes > length)
        rows, heads, sizes, start = rows[longer], heads[longer], sizes[longer], start[longer]
        start = start + FOLDED[data[heads + length - 1]] * weights[length - 1]
        if length in BEGINNINGS:
            found.append((rows, mix(start ^ np.uint64(length))))
    rows, hashes = (np.concatenate(x) for x in zip(*found))
    return rows, (hashes % np.uint64(SLOTS)).astype(np.int64)


class FactorizationMachine:
    """Weights for the slots that have one; a slot without weight adds nothing."""

    def __init__(self, slots: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.slots, self.bias, self.weights, self.factors = slots, bias, weights, factors
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[slots & 0xFFFF] = True

    def coded(self, rows: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of a row and the place of a slot that has a weight, ascending."""
        if not len(self.slots):
            return rows[:0], rows[:0]
        likely = np.flatnonzero(self.maybe[slots & 0xFFFF])
        rows, slots = rows[likely], slots[likely]
        at = np.minimum(np.searchsorted(self.slots, slots), len(self.slots) - 1)
        known = self.slots[at] == slots
        pair = np.unique(rows[known] * len(self.slots) + at[known])
        return pair // len(self.slots), pair % len(self.slots)

    def margins(self, rows: np.ndarray, slots: np.ndarray, count: int) -> np.ndarray:
        rows, at = self.coded(rows, slots)
        out = self.bias + np.bincount(rows, self.weights[at], minlength=count)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            total = np.bincount(rows, v, minlength=count)
            out += 0.5 * (total**2 - np.bincount(rows, v**2, minlength=count))
        return out

    def packed(self) -> dict:
        return {
            "slots": self.slots.tobytes(),
            "bias": self.bias,
            "weights": self.weights.tobytes(),
            "factors": self.factors.tobytes(),
        }

    @classmethod
    def unpacked(cls, row) -> FactorizationMachine:
        slots = np.frombuffer(row["slots"], dtype=np.int64)
        factors = np.frombuffer(row["factors"]).reshape(len(slots), FACTORS)
        return cls(slots, row["bias"], np.frombuffer(row["weights"]), factors)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def telling_slots(examples: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The slots whose presence goes with a label, ascending."""
    flat = np.concatenate([*examples, np.zeros(0, dtype=np.int32)])
    found, place, rows_with = np.unique(flat, return_inverse=True, return_counts=True)
    if not len(found):
        return found.astype(np.int64)
    toxic = np.bincount(place, np.repeat(labels, [len(e) for e in examples]))
    share = labels.mean()
    error = np.sqrt(rows_with * share * (1 - share))
    apart = np.abs(toxic - rows_with * share) >= LEAST_ERRORS * error
    return found[apart & (rows_with >= LEAST_ROWS)].astype(np.int64)


def fit(examples: list[np.ndarray], labels: np.ndarray) -> FactorizationMachine:
    """AdaGrad over mini-batches on log loss with L2; each example is its distinct slots.

    Labels that are all alike, or none, give a machine that answers with their rate.
    """
    rng = np.random.default_rng(SEED)
    positive = (float(labels.sum()) + 0.01) / (len(labels) + 0.02)
    bias = float(np.log(positive / (1 - positive)))
    one_kind = not len(labels) or labels.min() == labels.max()
    slots = np.zeros(0, dtype=np.int64) if one_kind else telling_slots(examples, labels)
    if not len(slots):
        return FactorizationMachine(slots, bias, np.zeros(0), np.zeros((0, FACTORS)))
    coded = []
    for example in examples:
        at = np.minimum(np.searchsorted(slots, example), len(slots) - 1)
        coded.append(at[slots[at] == example])
    weights = np.zeros(len(slots))
    factors = rng.normal(0, 0.01, (len(slots), FACTORS))
    seen_w, seen_v, seen_b = np.full(len(slots), 1e-6), np.full(factors.shape, 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(coded))
        for start in range(0, len(order), 256):
            part = order[start : start + 256]
            sizes = np.array([len(coded[i]) for i in part])
            row = np.repeat(np.arange(len(part)), sizes)
            at = np.concatenate([coded[i] for i in part])
            v = factors[at]
            total = np.stack(
                [np.bincount(row, v[:, f], minlength=len(part)) for f in range(FACTORS)], axis=1
            )
            squares = np.bincount(row, (v**2).sum(axis=1), minlength=len(part))
            linear = np.bincount(row, weights[at], minlength=len(part))
            margin = bias + linear + 0.5 * ((total**2).sum(axis=1) - squares)
            error = sigmoid(margin) - labels[part]
            used, place = np.unique(at, return_inverse=True)
            grad_w = np.bincount(place, error[row]) / len(part) + 1e-4 * weights[used]
            seen_w[used] += grad_w**2
            weights[used] -= 0.1 * grad_w / np.sqrt(seen_w[used])
            towards = error[row, None] * (total[row] - v)
            grad_v = np.stack([np.bincount(place, towards[:, f]) for f in range(FACTORS)], axis=1)
            grad_v = grad_v / len(part) + 1e-3 * factors[used]
            seen_v[used] += grad_v**2
            factors[used] -= 0.02 * grad_v / np.sqrt(seen_v[used])
            grad_b = float(error.mean())
            seen_b += grad_b**2
            bias -= 0.1 * grad_b / np.sqrt(seen_b)
    return FactorizationMachine(slots, bias, weights, factors)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text"):
            rows, slots = _terms(batch)
            pair = np.unique((rows.astype(np.uint64) << np.uint64(32)) | slots.astype(np.uint64))
            slots = (pair & np.uint64(0xFFFFFFFF)).astype(np.int32)
            rows = (pair >> np.uint64(32)).astype(np.int64)
            bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("label"),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(slots)),
                ],
                ["doc_id", "label", "slots"],
            )


def _fitted(table: pa.Table) -> pa.Table:
    table = table.sort_by([("doc_id", "ascending")])
    examples = [np.asarray(x.values) for x in table.column("slots")]
    model = fit(examples, table.column("label").to_numpy().astype(float))
    return pa.Table.from_pylist([model.packed()])


def train(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """A machine fitted on (doc_id, text, label), on at most about ``rows`` of them.

    Rows are chosen by a hash of doc_id, so the sample is the same on every run.
    Fitting takes one task: its input is bounded by ``rows``.
    """
    count = labelled.count()
    share = min(1.0, rows / count) if count else 1.0
    chosen = labelled.where(
        F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) < int(share * (1 << 20))
    )
    made = chosen.mapInArrow(_examples, "doc_id long, label int, slots array<int>")
    schema = "slots binary, bias double, weights binary, factors binary"
    row = made.groupBy(F.lit(1).alias("all")).applyInArrow(_fitted, schema).first()
    if row is None:
        return fit([], np.zeros(0))
    return FactorizationMachine.unpacked(row)


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for whole in batches:
            for batch in pieces(whole, "text"):
                rows, slots = _terms(batch)
                score = sigmoid(machine.margins(rows, slots, batch.num_rows))
                at = batch.schema.get_field_index("text")
                columns = [c for i, c in enumerate(batch.columns) if i != at]
                names = [n for i, n in enumerate(batch.schema.names) if i != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], [*names, "score"])

    return run


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from training: a fifth, by crc32 of its id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def labelled_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows (doc_id, text, label): labelled and not held out.

    Of several labels for one document the highest counts; null labels do not.
    """
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int"))
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("label"))
        .where(~held_out(F.col("doc_id")))
    )
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    return texts.join(marks, "doc_id").select("doc_id", "text", "label")


def _scored_rows(documents: DataFrame, machine: FactorizationMachine, keep: list[str]) -> DataFrame:
    """The columns ``keep`` as k0, k1, ... beside score."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)
    kept = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    rows = documents.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.mapInArrow(
        _scored(shared), StructType([*kept.schema.fields, StructField("score", DoubleType())])
    )


def scores(documents: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """Rows (doc_id, score): the probability that a text is toxic.

    The score depends on the whole text alone. Null and empty texts get the score of a
    text without terms. Repeated rows are scored as often as they come, null ids too;
    other columns are ignored.
    """
    return _scored_rows(documents, machine, ["doc_id"]).select(
        F.col("k0").cast("long").alias("doc_id"), "score"
    )


def without_toxic(
    documents: DataFrame, machine: FactorizationMachine, least: float = 0.5
) -> DataFrame:
    """The documents that score below ``least``, with all their columns as they are."""
    names = documents.columns
    scored = _scored_rows(documents, machine, names).where(F.col("score") < least)
    return scored.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])
