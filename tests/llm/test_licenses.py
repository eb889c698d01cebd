"""Dice scores against brute force over every unit and template."""

from __future__ import annotations

import re

from partloom.llm import licenses as lic


def grams(text):
    words = re.findall(r"[^\W_]+(?:[.\-][^\W_]+)*", text.lower())
    return set(zip(words, words[1:]))


def expected(text):
    text = text or ""
    lines = text.split("\n")
    blocks = {b for b in [*re.split(r"\n[\x20\x09\r]*\n\s*", text), text] if "\n" in b}
    names, best, lined = set(), None, 0
    for kind, units in (("line", lines), ("block", blocks)):
        for unit in units:
            g, here = grams(unit), set()
            for number, (name, template) in enumerate(lic.TEMPLATES):
                t = grams(template)
                if g and t and 2 * len(g & t) >= lic.LEAST * (len(g) + len(t)):
                    here.add(name)
                    score = (2 * len(g & t) / (len(g) + len(t)), -number, name)
                    best = max(best, score) if best else score
            names |= here
            lined += len(here) if kind == "line" else 0
    return sorted(names), best and best[2], best and round(best[0], 6), lined


def check(frame):
    for r in frame.collect():
        assert (r.licenses, r.best_license, r.best_score, r.n_matches) == expected(r.text)


def test_documents(documents):
    check(lic.license_matches(documents))


def test_whole_licenses_changed_ones_and_others(spark):
    mit = next(t for n, t in lic.TEMPLATES if n == "MIT" and len(t) > 500)
    wrapped = "\n".join(re.findall(r".{1,60}(?: |$)", mit))
    texts = [
        mit,
        "Copyright 2020 Somebody\n\n" + wrapped + "\n\nSome code follows here.",
        mit.replace("Software", "Program"),
        "released  UNDER the\tMIT license",
        "Released under no license at all.",
        "The MIT License is a license.",
        "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-SA 4.0.\nLicensed under CC BY-NC 4.0.",
        "Licensed",
        mit + " ".join(f" word{i}" for i in range(400)),
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = lic.license_matches(frame)
    check(got)
    found = {r.doc_id: r.licenses for r in got.collect()}
    assert found[0] == found[1] == found[2] == found[3] == ["MIT"]
    assert found[4] == found[7] == found[8] == []


def test_edges(edges, empty):
    got = lic.license_matches(edges)
    assert got.count() == edges.count()
    check(got)
    assert lic.license_matches(empty).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
