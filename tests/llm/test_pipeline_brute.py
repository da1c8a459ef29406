"""The whole pipeline on a small fixture against a plain Python version of its five stages."""

import re
import unicodedata

import numpy as np
from test_dedup import brute_lines, words
from test_quality import brute, em
from test_text_ops import brute_contamination

import corpus_pipeline as cp
from tessella.llm import packing
from tessella.llm import quality_rules as qr


def quality(rows):
    """Kept rows: votes by the rules' own conditions, accuracies by numpy."""
    counts = []
    for _, t, *_ in rows:
        t = t or ""
        w, chars, symbols, dups, repeats = brute(t)
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        kinds = [unicodedata.category(c) for c in t]
        counts.append({
            "n_words": w, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups, "n_repeat_words": repeats, "n_lines": len(lines),
            "n_upper": kinds.count("Lu"), "n_letters": sum(k[0] == "L" for k in kinds), "n_distinct": len(set(t.split())), "n_marks": len(re.findall(r"[#*$%&|<>]+", t)),
            "n_ends": len(re.findall(r"[.!?](?:[\x20\x09-\x0D]|\Z)", t)), "n_broken": len(re.findall(r"[.!?][\x20\x09-\x0D]+[a-z]", t)), "n_latin": len(re.findall("[A-Za-z]", t)),
            "n_vowels": len(re.findall("[AEIOUYaeiouy]", t)),
        })

    def holds(rule, c):
        return eval(rule.replace("AND", "and").replace("OR", "or").replace(" = ", " == "), {}, c)  # noqa: S307

    votes = np.array([[0 if holds(r.bad, c) else 2 if holds(r.good, c) else 1 for r in qr.RULES] for c in counts])
    p = em(votes, np.ones(len(votes)))
    failed = [c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"] for c in counts]
    return [r for r, f, x in zip(rows, failed, p) if not f and x > qr.KEEP_OVER]


def first_of_group(rows, n=5, least=0.8):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) / len(a | b) >= least):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for g, (i, _) in zip(group, rows):
        low[g] = min(low.get(g, i), i)
    return [r for g, r in zip(group, rows) if r[0] == low[g]]


def fixture():
    rng = np.random.default_rng(12)
    sentence = lambda n: " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, rng.integers(2, 8))) for _ in range(n)) + "."
    docs = [(i, "\n".join(sentence(int(rng.integers(8, 40))).capitalize() for _ in range(int(rng.integers(3, 7))))) for i in range(40)]
    banner = "All the pages of this site carry this line"
    docs += [(100 + i, f"{docs[i][1]}\n{banner}") for i in range(8)]
    docs += [(200 + i, docs[10 + i][1]) for i in range(4)]
    docs += [(210 + i, f"{docs[14][1]}") for i in range(3)]
    for i in range(4):
        w = docs[20 + i][1].split(" ")
        w[3] = "replaced"
        docs.append((300 + i, " ".join(w)))
    items = [(k, sentence(30)) for k in range(5)] + [(9, None)]
    docs += [(400 + k, f"{sentence(40).capitalize()}\n{items[k][1].upper() if k == 0 else items[k][1]}\n{sentence(40)}") for k in range(5)]
    docs += [(500, None), (501, ""), (502, "few words"), (503, "same " * 60), (504, " ".join(f"w{k}***" for k in range(40))), (505, f"{sentence(9)}\n" * 12)]
    return docs, items


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, items = fixture()
    spark.createDataFrame([(i, t, None, "s", None) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = quality(docs)
    assert 40 <= len(rows) < len(docs)
    rows = [(i, text) for i, _, _, text in brute_lines(rows)]
    rows = first_of_group(rows)
    bad = {r[0] for r in brute_contamination(rows, items) if r[5]}
    assert len(bad) >= 4
    rows = [r for r in rows if r[0] not in bad]
    want = sorted((i, 0, len(words(t))) for i, t in rows)
    out = cp.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.chunk, r.n_tokens) for r in out) == want
    lengths, counts = np.unique([n for *_, n in want], return_counts=True)
    edges = packing.boundaries(lengths, counts)
    for r in out:
        assert r.bucket == min(e for e in edges if e >= r.n_tokens)
    for b in edges:
        room, places = packing.BUDGET // max(b, 1), sorted((r.batch, r.slot) for r in out if r.bucket == b)
        assert places == [(k // room, k % room) for k in range(len(places))]


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
