"""Repeated byte strings against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest

from partloom.llm import suffix_dedup as s


def expected(texts):
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for i in range(len(raw) - s.LENGTH + 1):
            window = raw[i : i + s.LENGTH]
            if window in seen:
                covered[i : i + s.LENGTH] = b"\1" * s.LENGTH
            seen.add(window)
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        runs = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out.append((len(raw), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(frame, rows, **options):
    got = {r.doc_id: tuple(r[1:]) for r in s.without_repeats(frame, **options).collect()}
    rows = sorted(rows, key=lambda r: r[0])
    wanted = dict(zip([i for i, _ in rows], expected([t for _, t in rows])))
    assert got == wanted


def test_documents(documents, texts):
    few = {i: t for i, t in texts.items() if len(t) < 3000}
    frame = documents.where("length(text) < 3000")
    check(frame, list(few.items()))


@pytest.fixture(scope="module")
def passages():
    """Texts of shared passages in varied surroundings, periodic text, near copies."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40), text(25), text(18), "ab " * 90, "x" * 160, "For " * 60]
    rows = []
    for i in range(70):
        parts = [rng.choice(shared) if rng.random() < 0.5 else text(rng.randrange(30)) for _ in range(4)]
        rows.append((i * 3, " ".join(parts)))
    rows += [(1000, rows[5][1]), (1001, rows[6][1][7:]), (1002, rows[7][1][:-50] + "!")]
    rows += [(1003, "y" * 99), (1004, "y" * 100), (1005, "y" * 101), (1006, None), (1007, "")]
    return rows


@pytest.mark.parametrize("batches", [1, 3, 8])
def test_shared_passages_in_batches(spark, passages, batches):
    frame = spark.createDataFrame(passages, "doc_id long, text string").repartition(5)
    check(frame, passages, batches=batches)


def test_names_with_many_regions_and_long_texts(spark, passages, monkeypatch):
    """The window path, and texts longer than a segment."""
    monkeypatch.setattr(s, "HOT_REGIONS", 2)
    rows = passages[:40] + [(5000, " ".join(t or "" for _, t in passages[20:60]))]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_segments_of_a_long_row():
    import numpy as np

    offsets = np.array([0, 5, 5, 3_000_000, 3_000_010])
    found = list(s._segments(None, offsets))
    covered = set()
    for row, before, bounds in found:
        if len(bounds) == 2 and row == 2:
            start, end = before, before + int(bounds[1] - bounds[0])
            covered |= set(range(start, end - s.LENGTH + 1))
    assert covered == set(range(3_000_000 - 5 - s.LENGTH + 1))


def test_edges(edges, empty):
    rows = s.without_repeats(edges).collect()
    assert len(rows) == edges.count()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
    # Null ids come first, so the same text under id 1 is a repeat, and under id 7 twice.
    assert sorted(r.n_removed for r in of[None]) == [0, 0]
    assert of[1][0].n_removed == of[1][0].n_bytes == of[7][0].n_removed == of[7][1].n_removed
    assert of[10][0].n_removed > of[10][0].n_bytes - 100
    assert s.without_repeats(empty).count() == 0


def test_levels_merge_like_a_counter(spark):
    family = s.SuffixFamily()
    sizes = []
    for batch in range(6):
        rows = [(batch * 10 + i, 0, f"{i} text of one batch, {batch} " * 9) for i in range(3)]
        family.add(spark.createDataFrame(rows, "id long, h long, text string"))
        sizes.append([level[0] for level in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2]]


def sampled(texts):
    """Rows by kind that one task makes of ``texts``."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict(
        {
            "id": pa.array(range(len(texts)), pa.int64()),
            "h": pa.array([0] * len(texts), pa.int64()),
            "text": pa.array(texts, pa.string()),
        }
    )
    rows = {}
    for found in s._sampled(iter([batch])):
        for row in found.to_pylist():
            rows.setdefault(row.pop("what"), []).append(tuple(row.values()))
    return rows


def test_portions_change_no_row(passages, monkeypatch):
    texts = [t or "" for _, t in passages]
    whole = sampled(texts)
    monkeypatch.setattr(s, "PORTION", 16)
    parted = sampled(texts)
    for kind in (s.INDEXED, s.ASKED):
        assert sorted(parted[kind]) == sorted(whole[kind])
    covered = lambda rows: {
        (r[2], p) for r in rows for p in range(r[4], r[4] + r[5] - 1 + s.LENGTH)
    }
    assert covered(parted[s.COVERED]) == covered(whole[s.COVERED])
    # Runs that touch are merged whatever their names: a portion adds a row at most.
    assert len(whole[s.COVERED]) <= len(parted[s.COVERED]) < 1.5 * len(whole[s.COVERED])


def test_memory_of_a_task_that_samples():
    """Beside its regions, a task holds little: portions at full width, and one segment."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    data = np.random.default_rng(7).integers(97, 123, 16 << 20, dtype=np.uint8).tobytes().decode()
    texts = [data[i : i + 4096] for i in range(0, len(data), 4096)]
    count = len(texts)
    batch = pa.RecordBatch.from_pydict({"id": list(range(count)), "h": [0] * count, "text": texts})
    tracemalloc.start()
    rows = sum(found.num_rows for found in s._sampled(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 500_000
    assert peak < 120 * rows


def test_small_batches(spark):
    """A task is handed a few megabytes of text at a time, and the setting comes back."""
    from pyspark.sql import functions as F

    from partloom.llm.storage import BATCH_BYTES, SMALL_BATCH_BYTES, small_batches

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    before = spark.conf.get(BATCH_BYTES)
    texts = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text"))
    with small_batches(spark):
        found = [r.bytes for r in texts.mapInArrow(sizes, "bytes long").collect()]
    assert sum(found) > 24_000_000 and max(found) < 1.1 * SMALL_BATCH_BYTES
    assert spark.conf.get(BATCH_BYTES) == before
