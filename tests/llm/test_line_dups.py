"""Repeated runs of lines against brute force."""

from __future__ import annotations

import random

import pytest

from partloom.llm import line_dups


def expected(texts, width):
    """(n_lines, removed line numbers, text) of rows in the order of documents."""
    seen, out = set(), []
    for text in texts:
        lines = (text or "").split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for k in range(len(full) - width + 1):
            part = full[k : k + width]
            window = tuple(lines[i].strip(" \t\n\x0b\x0c\r") for i in part)
            if window in seen:
                gone |= set(part)
            seen.add(window)
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((len(full), len(gone), text if text is None else left))
    return out


def found(frame):
    return {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in frame.collect()}


def test_documents(documents, texts):
    ids = sorted(texts)
    wanted = dict(zip(ids, expected([texts[i] for i in ids], line_dups.WINDOW)))
    assert found(line_dups.without_repeated_runs(documents)) == wanted


@pytest.mark.parametrize("width", [1, 2, 3])
def test_few_different_lines(spark, width):
    """Runs that overlap, repeat within a text, and start or end in others."""
    rng = random.Random(width)
    some = ["alpha", " beta", "beta\t", "gamma", "", "delta", "  "]
    rows = [(i, "\n".join(rng.choice(some) for _ in range(rng.randrange(9)))) for i in range(40)]
    rows += [(i + 100, "\n".join(f"line {rng.randrange(25)}" for _ in range(12))) for i in range(25)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = dict(zip([i for i, _ in rows], expected([t for _, t in rows], width)))
    assert found(line_dups.without_repeated_runs(frame, width)) == wanted


def test_long_lines_by_themselves(spark):
    """A passage of one line between other neighbours, as a whole document, and in one text."""
    passage = " ".join(f"w{i}" for i in range(20))
    texts = [
        f"a\n{passage}\nb",
        f"c\n\n  {passage}\t\nd\nshort line",
        passage,
        f"{passage} more\nx\n{passage} more\nshort line",
        passage.rsplit(" ", 1)[0],
        f"e\n{passage.rsplit(' ', 1)[0]}",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = found(line_dups.without_repeated_runs(frame, long_line=20))
    assert got[0] == (3, 0, texts[0])
    assert got[1] == (4, 1, "c\n\nd\nshort line")
    assert got[2] == (1, 1, "")
    assert got[3] == (4, 1, f"{passage} more\nx\nshort line")
    assert got[4] == (1, 0, texts[4]) and got[5] == (2, 0, texts[5])
    assert found(line_dups.without_repeated_runs(frame))[1][1] == 0


def test_edges(edges, empty):
    got = line_dups.without_repeated_runs(edges)
    rows = got.collect()
    assert len(rows) == edges.count()
    assert set(got.columns) == {*edges.columns, "n_lines", "n_removed", "n_runs"}
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
    assert of[2][0].text is None and of[3][0].text == ""
    assert [r.n_removed for r in of[7]] == [3, 3] and of[1][0].n_removed == 3
    assert sorted(r.n_removed for r in of[None]) == [0, 0]
    assert line_dups.without_repeated_runs(empty).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
