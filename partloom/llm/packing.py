"""Packing token sequences into windows by the online sum-of-squares rule."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
# Open windows that a packer holds at most: 2,048 ids each, so about 16 MB.
OPEN_WINDOWS = 2048
# Runs of so many characters are left to the tokenizer.
LONG_RUN = 100_000

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)
# The split pattern that the vocabulary was made with (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level_encoder(vocabulary: str):
    """A fast encoder with the ids of the byte-level BPE file ``vocabulary``.

    Merges of such a file are in the order of their ids, so ids serve as ranks.
    """
    import tiktoken

    alphabet = byte_alphabet()
    with open(vocabulary, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"] for t in model.get("added_tokens", ())}
    ranks = {
        bytes(alphabet[c] for c in token): number
        for token, number in model["model"]["vocab"].items()
        if token not in special
    }
    return tiktoken.Encoding(
        "byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary


def document_encoder(vocabulary: str):
    """The ids of the tokenizer with its own settings, by the fast encoder where it has them.

    Texts that hold an added token, or a run without or of nothing but white space that is
    too long for the fast encoder's matcher, go to the tokenizer itself.
    """
    from tokenizers import Tokenizer

    fast, whole = byte_level_encoder(vocabulary), Tokenizer.from_file(vocabulary)
    added = [token.content for token in whole.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(token in text for token in added) or (
            len(text) >= LONG_RUN
            and any(m.end() - m.start() >= LONG_RUN for m in re.finditer(r"\s+|\S+", text))
        ):
            return whole.encode(text, add_special_tokens=False).ids
        return fast(text)

    return encode


class Packer:
    """Windows in the making, by fill level.

    ``counts[h]`` is the number of windows filled to level h. A piece of s ids goes to
    the level whose choice leaves the smallest sum of squared counts; level 0 is a new
    window. Full windows are closed. Beyond ``OPEN_WINDOWS`` the open ones are poured
    together into full windows, which cuts pieces but pads nothing.
    """

    def __init__(self, first_id: int, window: int = WINDOW, most: int = OPEN_WINDOWS):
        self.window, self.most = window, most
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.levels: list[list[list]] = [[] for _ in range(window + 1)]
        self.open = 0
        self.next_id = first_id
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            self._close([(doc_id, start, ids[start : start + self.window], total)])
        if whole < total:
            self._place((doc_id, whole, ids[whole:], total))

    def _place(self, piece: tuple) -> None:
        size, counts = len(piece[2]), self.counts
        room = self.window - size
        # Twice (count above - count at the level), the change by moving one window up.
        change = 2 * (counts[size:] - counts[: room + 1]) + 2
        change[0] = 2 * counts[size] + 1
        change[room] = 1 - 2 * counts[room] if room else 0
        change[1:][counts[1 : room + 1] == 0] = np.iinfo(np.int64).max
        level = int(change.argmin())
        content = self.levels[level].pop() if level else []
        counts[level] -= level > 0
        self.open -= level > 0
        content.append(piece)
        if level + size == self.window:
            self._close(content)
            return
        self.levels[level + size].append(content)
        counts[level + size] += 1
        self.open += 1
        if self.open > self.most:
            self._pour(last=False)

    def _pour(self, last: bool) -> None:
        """Cut the open windows into full ones; the rest stays open, or is closed at the end."""
        pieces = [p for level in reversed(self.levels) for content in level for p in content]
        for level in self.levels:
            level.clear()
        self.counts[:] = 0
        self.open = 0
        content, filled = [], 0
        for doc_id, start, ids, total in pieces:
            while len(ids):
                take = min(len(ids), self.window - filled)
                content.append((doc_id, start, ids[:take], total))
                start, ids, filled = start + take, ids[take:], filled + take
                if filled == self.window:
                    self._close(content)
                    content, filled = [], 0
        if content and last:
            self._close(content)
        elif content:
            self.levels[filled].append(content)
            self.counts[filled] = self.open = 1

    def _close(self, content: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in content:
            self.rows.append(
                (doc_id, start, len(ids), zlib.crc32(ids), total, self.next_id, offset)
            )
            offset += len(ids)
        self.next_id += 1

    def end(self) -> None:
        self._pour(last=True)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 7
        self.rows = []
        names = [field.split()[0] for field in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _packed(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = document_encoder(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                packer.add(doc_id.as_py(), np.array(ids, dtype="<u4"))
                if len(packer.rows) > 50_000:
                    yield packer.batch()
        packer.end()
        yield packer.batch()

    return run


def packed(documents: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """All documents cut into pieces and packed into sequences of at most 2,048 ids.

    A document is the ids of its whole text and then ``end_id``. Full windows of a long
    document are sequences of their own; what is left over is placed by the
    sum-of-squares rule, document by document as they come. Each task packs the
    documents of its own partition with a level array and a bounded number of open
    windows, so nothing is shuffled, and its sequence ids start at its partition
    number shifted by 40 bits. At most the last sequence of a partition has padding.

    Returned per piece: doc_id, start, length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), doc_tokens, sequence_id, offset. Null and empty texts
    give the one id ``end_id``. A null doc_id stays null; repeated rows are packed as
    often as they come; other columns are ignored; an empty table gives no rows.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_packed(vocabulary, end_id), PIECES)
