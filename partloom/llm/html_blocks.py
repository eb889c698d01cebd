"""HTML to leaf blocks: their text, the path of open tags, and feature vectors."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from partloom.llm.words import FOLDED, LETTERS, hash_words, text_buffers

# Elements that hold no readable text, end without a tag, or do not part blocks (fixed values).
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object")
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
# Which open elements a new element ends (fixed values).
ENDS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 "
    "h6 header hr main menu nav ol p pre section table ul".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # Self-closed, these hold nothing; a longer name is another element.
    r"|<(?:svg|object)(?=[\s/>])[^>]*+(?<=/)>"
    rf"|<({'|'.join(RAW)})(?=[\s/>])[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

PATH_SIZE = 96
WORD_SIZE = 48
SHAPE_SIZE = 6
SIZE = PATH_SIZE + WORD_SIZE + SHAPE_SIZE


@dataclass
class Block:
    path: list[str]
    names: list[str]
    text: str = ""
    linked: int = 0
    parts: list[str] = field(default_factory=list)


def _names(attributes: str) -> list[str]:
    """The words of an element's class, id and role."""
    found = []
    for groups in _NAMED.findall(attributes):
        found += [p.lower() for p in _PART.findall(next((g for g in groups if g), ""))]
    return found


def blocks(page: str) -> list[Block]:
    """The non-empty text blocks of a page in order.

    A block is the text between tags of block level; tags inside a line do not part it.
    Character references are decoded, white space becomes one space and is trimmed.
    """
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    current = Block([], [])

    def close() -> None:
        nonlocal current
        text = " ".join("".join(current.parts).split())
        if text:
            current.text = text
            out.append(current)
        current = Block([], [])

    def add(raw: str) -> None:
        if not raw:
            return
        if not current.parts:
            current.path = [tag for tag, _ in stack]
            current.names = [name for _, names in stack for name in names]
        text = html.unescape(raw)
        current.parts.append(text)
        if any(tag == "a" for tag, _ in stack):
            current.linked += len(text)

    def pop(tags: tuple[str, ...]) -> None:
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in tags:
                del stack[at:]
                return
            if stack[at][0] in ("ul", "ol", "dl", "table", "article", "section", "div"):
                return

    at = 0
    for token in _TOKEN.finditer(page):
        add(page[at : token.start()])
        at = token.end()
        tag = (token[3] or token[6] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            close()
        if token[2] or token[5]:
            places = [i for i, (open_tag, _) in enumerate(stack) if open_tag == tag]
            if places:
                del stack[places[-1] :]
            continue
        if tag in ENDS_PARAGRAPH:
            pop(("p",))
        if tag in ENDS:
            pop(ENDS[tag])
        if tag not in VOID:
            stack.append((tag, _names(token[4] or token[7] or "")))
    add(page[at:])
    close()
    return out


def _slot(word: str, size: int) -> tuple[int, float]:
    """A place and a sign for a feature, the same in every process."""
    code = 2166136261
    for byte in word.encode():
        code = (code ^ byte) * 16777619 & 0xFFFFFFFF
    code ^= code >> 15
    code = code * 0x2C1B3C6D & 0xFFFFFFFF
    code ^= code >> 12
    return code % size, 1.0 if code >> 31 else -1.0


class Features:
    """Feature vectors of the blocks of a page; path features are remembered."""

    def __init__(self):
        self.slots: dict[str, tuple[int, float]] = {}

    def _path(self, block: Block) -> np.ndarray:
        out = np.zeros(PATH_SIZE, dtype=np.float32)
        words = {f"t:{t}" for t in block.path} | {f"n:{n}" for n in block.names}
        words.add("e:" + "/".join(block.path[-2:]))
        for word in words:
            slot = self.slots.get(word)
            if slot is None:
                if len(self.slots) > 100_000:
                    self.slots.clear()
                slot = self.slots[word] = _slot(word, PATH_SIZE)
            out[slot[0]] += slot[1]
        return out

    def of(self, found: list[Block]) -> np.ndarray:
        """One row a block: hashed tag path, hashed words, and shape."""
        out = np.zeros((len(found), SIZE), dtype=np.float32)
        if not found:
            return out
        data, offsets = text_buffers(pa.array([b.text for b in found], pa.string()))
        hashes, rows, *_ = hash_words(data, offsets, LETTERS, FOLDED)
        counts = np.bincount(rows, minlength=len(found)).astype(np.float32)
        slots = (hashes % np.uint64(WORD_SIZE)).astype(np.int64)
        signs = np.where(hashes >> np.uint64(63), 1.0, -1.0)
        bags = np.bincount(rows * WORD_SIZE + slots, signs, minlength=len(found) * WORD_SIZE)
        out[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = bags.reshape(len(found), WORD_SIZE) / np.sqrt(
            np.maximum(counts, 1)
        )[:, None]
        for i, block in enumerate(found):
            out[i, :PATH_SIZE] = self._path(block)
        chars = np.array([len(b.text) for b in found], dtype=np.float32)
        marks = np.array([sum(b.text.count(c) for c in ".,;:!?") for b in found])
        out[:, -6] = np.log1p(counts) / 3
        out[:, -5] = np.log1p(chars) / 5
        out[:, -4] = np.array([b.linked for b in found]) / np.maximum(chars, 1)
        out[:, -3] = np.minimum(marks / np.maximum(counts, 1), 1)
        out[:, -2] = np.arange(len(found)) / len(found)
        out[:, -1] = 1.0
        return out
