"""Main text of web pages from a recurrent block labeller.

A page is the sequence of its leaf blocks. A bidirectional LSTM in numpy reads a vector
for each block (hashed tag path, hashed words, shape) in both directions, so the label
of a block, main text or not, depends on the whole page. It is trained here, on a
bounded sample of the pages themselves: blocks whose containers say what they are give
the labels, and copies of the pages with other containers, inserted boilerplate and
hidden paths teach it to use names, words and neighbours alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.html_blocks import PATH_SIZE, SIZE, Block, Features, blocks

HIDDEN = 16
# Pages that the labeller is trained on at most, chosen by a hash of url and page_id, and
# how many blocks of each.
SAMPLE_PAGES = 300
SAMPLE_BLOCKS = 200
EPOCHS = 12
SEED = 5

# Words that containers of main text or of something else bear (fixed values).
MAIN_TAGS = ("article", "main")
MAIN_NAMES = (
    "article content main post entry story body text page".split()
)
OTHER_TAGS = (
    "head title nav header footer aside form menu button select option dialog figcaption".split()
)
OTHER_NAMES = (
    "ad ads advert advertisement advertising sponsor sponsored promo banner sidebar side rail "
    "comment comments reply replies respond disqus nav navigation navbar menu breadcrumb "
    "breadcrumbs header masthead topbar footer foot bottom copyright notice notices cookie "
    "cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup "
    "login search share sharing social related recommended recommendations trending widget "
    "toolbar pagination pager form legal disclaimer skip tags"
).split()
OTHER_PATHS = (
    [[t] for t in ("nav", "header", "footer", "aside", "form", "menu")]
    + [["nav", "ul", "li", "a"], ["aside", "ul", "li"], ["footer", "p"], ["header", "h1"]]
    + [["form", "label"], ["aside", "p"], ["dialog", "p"], ["form", "p"], ["form", "button"]]
)
MAIN_PATHS = (["article"], ["main"], ["main", "article"], ["div"], ["section"], ["body"])


def hint(block: Block) -> int:
    """What a block's containers say: 1 main text, 0 something else, -1 nothing clear."""
    if any(t in OTHER_TAGS for t in block.path) or any(n in OTHER_NAMES for n in block.names):
        return 0
    if any(t in MAIN_TAGS for t in block.path) or any(n in MAIN_NAMES for n in block.names):
        return 1
    words = block.text.count(" ") + 1
    if words >= 20 and 3 * block.linked < len(block.text):
        return 1
    return 0 if 2 * block.linked > len(block.text) else -1


class Lstm:
    """One direction of a long short-term memory over padded sequences."""

    def __init__(self, rng, size: int, hidden: int):
        scale = 1 / np.sqrt(size + hidden)
        self.w = rng.normal(0, scale, (size, 4 * hidden)).astype(np.float32)
        self.u = rng.normal(0, scale, (hidden, 4 * hidden)).astype(np.float32)
        self.b = np.zeros(4 * hidden, dtype=np.float32)
        self.b[hidden : 2 * hidden] = 1.0
        self.hidden = hidden

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Outputs (time, batch, hidden); states reset to zero where the mask is zero."""
        steps, batch, _ = x.shape
        n = self.hidden
        into = x @ self.w + self.b
        h = np.zeros((batch, n), dtype=np.float32)
        c = np.zeros_like(h)
        out = np.zeros((steps, batch, n), dtype=np.float32)
        trace = []
        for t in range(steps):
            gates = into[t] + h @ self.u
            # Input, forget and output gates, then the candidate.
            igo = 1 / (1 + np.exp(-np.clip(gates[:, : 3 * n], -30, 30)))
            i, f, o = igo[:, :n], igo[:, n : 2 * n], igo[:, 2 * n :]
            g = np.tanh(gates[:, 3 * n :])
            before_h, before_c = h, c
            m = mask[t][:, None]
            c = (f * c + i * g) * m
            tc = np.tanh(c)
            h = o * tc * m
            out[t] = h
            if keep:
                trace.append((i, f, o, g, tc, before_h, before_c, m))
        return out, trace

    def backward(self, x: np.ndarray, trace: list, dout: np.ndarray):
        n = self.hidden
        dgates = np.zeros((len(trace), x.shape[1], 4 * n), dtype=np.float32)
        du = np.zeros_like(self.u)
        dh = np.zeros((x.shape[1], n), dtype=np.float32)
        dc = np.zeros_like(dh)
        for t in range(len(trace) - 1, -1, -1):
            i, f, o, g, tc, before_h, before_c, m = trace[t]
            dh = (dh + dout[t]) * m
            dc = dc * m + dh * o * (1 - tc**2)
            d = dgates[t]
            d[:, :n] = dc * g * i * (1 - i)
            d[:, n : 2 * n] = dc * before_c * f * (1 - f)
            d[:, 2 * n : 3 * n] = dh * tc * o * (1 - o)
            d[:, 3 * n :] = dc * i * (1 - g**2)
            d *= m
            du += before_h.T @ d
            dh = d @ self.u.T
            dc = dc * f * m
        dw = np.einsum("tbs,tbg->sg", x, dgates, optimize=True)
        return [dw, du, dgates.sum(axis=(0, 1))]

    def parameters(self) -> list[np.ndarray]:
        return [self.w, self.u, self.b]


class Labeller:
    """Both directions and a logistic output for each block."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(rng, SIZE, HIDDEN), Lstm(rng, SIZE, HIDDEN)
        self.v = rng.normal(0, 0.1, 2 * HIDDEN).astype(np.float32)
        self.c = np.zeros(1, dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.ahead.parameters(), *self.back.parameters(), self.v, self.c]

    def load(self, weights: bytes) -> Labeller:
        flat, at = np.frombuffer(weights, dtype=np.float32), 0
        for p in self.parameters():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def dump(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.parameters()]).tobytes()

    def _run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        ahead, one = self.ahead.forward(x, mask, keep)
        back, two = self.back.forward(x[::-1], mask[::-1], keep)
        joined = np.concatenate([ahead, back[::-1]], axis=2)
        p = 1 / (1 + np.exp(-np.clip(joined @ self.v + self.c, -30, 30)))
        return p, joined, one, two

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page the probability of each block; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        for low in range(0, len(order), 64):
            part = order[low : low + 64]
            x, mask = padded([pages[i] for i in part])
            p = self._run(x, mask)[0]
            for column, i in enumerate(part):
                out[i] = p[: len(pages[i]), column]
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> Labeller:
        """Adam on log loss over the blocks whose label is 0 or 1."""
        rng = np.random.default_rng(SEED)
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        step = 0
        for _ in range(EPOCHS):
            # Pages of like length share a batch; batches come in random order.
            order = sorted(range(len(pages)), key=lambda i: (len(pages[i]), rng.random()))
            batches = [order[i : i + 32] for i in range(0, len(order), 32)]
            for at in rng.permutation(len(batches)):
                part = batches[at]
                x, mask = padded([pages[i] for i in part])
                y = np.full(mask.shape, -1.0, dtype=np.float32)
                for column, i in enumerate(part):
                    y[: len(labels[i]), column] = labels[i]
                known = y >= 0
                p, joined, one, two = self._run(x, mask, keep=True)
                error = np.where(known, p - y, 0) / max(1, int(known.sum()))
                dv = np.einsum("tb,tbh->h", error, joined)
                djoined = error[:, :, None] * self.v
                gradients = [
                    *self.ahead.backward(x, one, djoined[:, :, :HIDDEN]),
                    *self.back.backward(x[::-1], two, djoined[::-1, :, HIDDEN:]),
                    dv,
                    error.sum().reshape(1),
                ]
                step += 1
                for p_, g, a, b in zip(self.parameters(), gradients, first, second):
                    g = np.clip(g, -1, 1)
                    a += 0.1 * (g - a)
                    b += 0.001 * (g**2 - b)
                    p_ -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pages as one array (time, page, feature) and the mask of its real blocks."""
    longest = max(len(p) for p in pages)
    x = np.zeros((longest, len(pages), SIZE), dtype=np.float32)
    mask = np.zeros((longest, len(pages)), dtype=np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i] = p
        mask[: len(p), i] = 1
    return x, mask


def _varied(page: list[Block], labels: list[int], rng) -> tuple[list[Block], list[int]]:
    """A copy of a page with main text in another container and boilerplate put in."""
    words = " ".join(b.text for b in page).split()
    main = list(MAIN_PATHS[rng.integers(len(MAIN_PATHS))])
    names = [MAIN_NAMES[rng.integers(len(MAIN_NAMES))]] if rng.random() < 0.7 else []
    out, marks = [], []

    def some(path: list[str], name: str | None) -> Block:
        count = int(rng.integers(1, 30))
        start = int(rng.integers(max(1, len(words) - count)))
        text = " ".join(words[start : start + count]) or "x"
        linked = len(text) if path[-1] == "a" or rng.random() < 0.3 else 0
        return Block(["html", "body", *path], [name] if name else [], text, linked)

    def insert(inside: bool) -> None:
        if rng.random() < 0.5:
            tags = list(OTHER_PATHS[rng.integers(len(OTHER_PATHS))])
            name = None
        else:
            tags = [["div"], ["section"], ["div", "p"], ["ul", "li"], ["div", "span"]][rng.integers(5)]
            name = OTHER_NAMES[rng.integers(len(OTHER_NAMES))]
        for _ in range(int(rng.integers(1, 5))):
            block = some((main if inside else []) + list(tags), name)
            block.names += names if inside else []
            out.append(block)
            marks.append(0)

    for _ in range(int(rng.integers(0, 3))):
        insert(False)
    for block, label in zip(page, labels):
        if label == 1:
            kept = [t for t in block.path if t not in (*MAIN_TAGS, "html", "body")]
            block = Block(["html", "body", *main, *kept], names, block.text, block.linked)
            if rng.random() < 0.08:
                insert(True)
        out.append(block)
        marks.append(label)
    for _ in range(int(rng.integers(0, 4))):
        insert(False)
    return out, marks


def train(pages: list[str]) -> Labeller:
    """A labeller fitted on some pages and on varied copies of them."""
    rng = np.random.default_rng(SEED)
    features = Features()
    inputs, labels = [], []
    for page in pages:
        found = blocks(page)[:SAMPLE_BLOCKS]
        if not found:
            continue
        hints = [hint(b) for b in found]
        copies = [(found, hints)] + [_varied(found, hints, rng) for _ in range(4)]
        for number, (page_blocks, marks) in enumerate(copies):
            vectors = features.of(page_blocks)
            if number % 2:
                hidden = rng.random(len(vectors)) < 0.1
                vectors[hidden, :PATH_SIZE] = 0
            inputs.append(vectors)
            labels.append(np.array(marks, dtype=np.float32))
    model = Labeller()
    return model.fit(inputs, labels) if inputs else model


def _trained(table: pa.Table) -> pa.Table:
    ordered = table.sort_by([("at", "ascending"), ("html", "ascending")])
    return pa.table({"weights": [train(ordered.column("html").to_pylist()).dump()]})


def trained(pages: DataFrame, count: int = SAMPLE_PAGES) -> bytes:
    """Weights of a labeller fitted on at most about ``count`` pages, in one task."""
    rows = pages.count()
    share = min(1.0, count / rows) if rows else 1.0
    at = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30))
    chosen = (
        pages.where("html IS NOT NULL")
        .select(at.alias("at"), "html")
        .where(F.col("at") < int(share * (1 << 30)))
    )
    fitted = chosen.groupBy(F.lit(1).alias("all")).applyInArrow(_trained, "weights binary")
    row = fitted.first()
    return row["weights"] if row else Labeller().dump()


def _extracted(weights: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = Labeller().load(weights), Features()
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                pages = [blocks(h or "") for h in batch.column("html").to_pylist()]
                scored = model.probabilities([features.of(p) for p in pages])
                texts = [
                    " ".join(b.text for b, p in zip(page, probability) if p >= 0.5)
                    for page, probability in zip(pages, scored)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("page_id"),
                        batch.column("url"),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    ["page_id", "url", "text", "n_chars"],
                )

    return run


def main_text(pages: DataFrame, weights: bytes) -> DataFrame:
    """Rows (page_id, url, text, n_chars): the blocks labelled main text, joined by a space.

    Null and empty html, and pages without main text, give an empty text. Rows are
    returned as often as they come, also with null page_id or url; other columns are
    ignored; text holds whole blocks, whatever their number or length.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    schema = "page_id long, url string, text string, n_chars long"
    return rows.mapInArrow(_extracted(weights), schema)
