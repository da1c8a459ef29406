"""Licence scans against plain loops."""

import re

import pytest

from tessella.llm import license_scan as ls

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute(text):
    """Every start of every template is tried; no hashes, votes by counting equal runs."""
    w = words(text)
    at, n_base, base, labels, score = [], 0, set(), set(), 0.0
    for label, phrase in ls.PHRASES:
        t = phrase.split(" ")
        for p in range(len(w) - len(t) + 1):
            if w[p : p + len(t)] == t:
                at.append(p)
                n_base += 1
                base.add(label)
    labels |= base
    score = 1.0 if base else 0.0
    get = lambda i: w[i] if 0 <= i < len(w) else None
    for label, text_, keys in ls.TEMPLATES:
        t = text_.split(" ")
        m = len(t) - ls.K + 1
        votes = {}
        for d in range(-len(t), len(w)):
            v = {k for k in range(m) if d + k >= 0 and w[d + k : d + k + ls.K] == t[k : k + ls.K]}
            if v:
                votes[d] = v
        for d, v in votes.items():
            near = {x: votes[x] for x in range(d - ls.DRIFT, d + ls.DRIFT + 1) if x in votes}
            if max((len(y), -x) for x, y in near.items()) != (len(v), -d) or 2 * len(set().union(*near.values())) < m:
                continue
            beside = range(-ls.DRIFT, ls.DRIFT + 1)
            share = sum(any(get(d + k + o) == x for o in beside) for k, x in enumerate(t)) / len(t)
            kept = True
            for k in keys:
                k = k.split(" ")
                a = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
                kept &= any([get(d + a + o + i) for i in range(len(k))] == k for o in beside)
            if kept and share >= ls.LEAST_SHARE:
                labels.add(label)
                score = max(score, share)
    return len(w), n_base, min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


MIT, GPL, LGPL = (next(t for x, t, _ in ls.TEMPLATES if x == name) for name in ("mit", "gpl-3", "lgpl-3"))
FILL = "lorem ipsum dolor sit amet consectetur "


def texts():
    m = MIT.split(" ")
    without = " ".join(m[:10] + m[12:30] + ["really"] + m[30:])
    yield from (None, "", "...", "mit", FILL, "CC BY-NC", "Released under the MIT License.", "under the mit license under the MIT license, under the mit license")
    yield from (FILL * 200 + "Licensed under the Apache License, Version 2.0." + FILL * 100, FILL * 85 + "cc by nc cc by nc " + FILL * 300 + "cc by nc")
    yield from (MIT, FILL + MIT.upper() + " " + FILL, FILL * 84 + MIT + FILL, without, " ".join(m[5:]), " ".join(m[:12]), " ".join(m[::-1]), (MIT + " ") * 5, " ".join(m[:15] + FILL.split() + m[15:]))
    yield from (GPL, LGPL, GPL.replace("version 3", "version 4"), GPL.replace("general", "very general"), "This work is licensed under the GNU General Public License, version 3.", "licensed under the gnu lesser general public license version 3")
    yield from ("under the mit licenses", "apache license version 20", "Ünder the mit license", "xunder the mit license", "under\nthe\tMIT\x00license", MIT + MIT)


def test_scan_equals_plain_loops(spark, frame):
    rows = list(enumerate(texts())) + [(None, "under the mit license"), (3, MIT), (3, MIT)]
    out = ls.license_scan(frame(rows))
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, ((i, *brute(t)) for i, t in rows)))


def test_labels_of_planted_notices(spark, frame):
    rows = [(0, MIT), (1, GPL), (2, LGPL), (3, FILL * 400), (4, "licence " * 50), (5, f"{FILL} {ls.TEMPLATES[1][1]}, {FILL}")]
    got = {r.doc_id: r.labels for r in ls.license_scan(frame(rows)).collect()}
    assert got == {0: "mit", 1: "gpl-3", 2: "lgpl-3", 3: "", 4: "", 5: "agpl-3"}


def test_every_template_is_found_in_itself(spark, frame):
    rows = [(i, f"{FILL * i} {t} {FILL}") for i, (_, t, _) in enumerate(ls.TEMPLATES)]
    got = {r.doc_id: (r.labels, r.score) for r in ls.license_scan(frame(rows)).collect()}
    assert got == {i: (x, 1.0) for i, (x, _, _) in enumerate(ls.TEMPLATES)}


def test_templates_by_a_join_when_there_are_many(spark, frame, monkeypatch):
    monkeypatch.setattr(ls, "BROADCAST_PLACES", 0)
    got = {r.doc_id: r.labels for r in ls.license_scan(frame([(0, MIT), (1, None)])).collect()}
    assert got == {0: "mit", 1: ""}


def test_nothing_and_other_columns(spark, frame):
    assert ls.license_scan(frame([])).count() == 0
    odd = frame([(7, MIT)]).selectExpr("doc_id as `the.key`", "text as row", "1 as tpl", "2 as votes", "3 as doc", "4 as text")
    assert [tuple(r)[0] for r in ls.license_scan(odd, "the.key", "row").select("`the.key`", "labels").collect()] == [7]
    with pytest.raises(ValueError):
        ls.license_scan(frame([]), templates=(("x", "two words", ()),))
