"""The word model of op6 against brute force."""

import math
import re

import pytest
from pyspark.sql import functions as F

from tessella.llm import lm_score, word_model

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, targets):
    texts = [re.findall(r"[　-鿿]|[0-9a-z\x80-⿿ꀀ-\U0010ffff]+|[!-~]", (t or "").translate(UP)) for _, t in rows]
    texts = [[*t, None] if t else [] for t in texts]

    def counts(texts):
        one, two = {}, {}
        for t in texts:
            for a, b in zip([None, *t], t):
                one[b] = one.get(b, 0) + 1
                two[a, b] = two.get((a, b), 0) + 1
        return one, two

    vocabulary, r = len({w for t in texts for w in t}), word_model.RESERVE

    def mean(k, use):
        """Of text k by the model of all other texts in use."""
        if not texts[k]:
            return 0.0
        one, two = counts([t for i, (t, u) in enumerate(zip(texts, use)) if u and i != k])
        total, t = sum(one.values()), texts[k]
        return sum(-math.log((two.get((a, b), 0) + r * (one.get(b, 0) + 1) / (total + vocabulary)) / (one.get(a, 0) + r)) for a, b in zip([None, *t], t)) / len(t)

    return [(max(0, len(t) - 1), mean(k, targets), mean(k, [True] * len(texts))) for k, t in enumerate(texts)]


@pytest.mark.parametrize("block, size", [(1 << 22, 1 << 24), (40, 50)])
def test_word_scores(frame, monkeypatch, block, size):
    monkeypatch.setattr(word_model, "BLOCK", block)
    monkeypatch.setattr(word_model, "RANGE", size)
    rows = [(1, "the cat sat on the mat"), (2, "The dog sat, the cat (sat)"), (3, "zzz### qqq"), (4, None), (5, ""), (6, "Ñandú é"), (6, "the end\tof\nit"), (7, "x " * 300), (None, "cat")]
    rows += [(8, "日本語です a日b"), (9, " \n "), (10, "the"), (11, "the cat sat on the mat")]
    got = sorted((str(r.doc_id), r.n_tokens, r.target_loss, r.background_loss) for r in word_model.score(frame(rows), F.col("doc_id") <= 2).collect())
    want = brute(rows, [i is not None and i <= 2 for i, _ in rows])
    for g, w in zip(got, sorted((str(i), *w) for (i, _), w in zip(rows, want)), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=2e-6) and g[3] == pytest.approx(w[3], abs=2e-6)
    assert word_model.score(frame([]), F.lit(True)).count() == 0


def test_the_query_tells_words_of_one_byte_class_apart(spark, frame):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(i, "ā ā ā ā ā") for i in (1, 2, 4)] + [(i, "ġ ġ ġ ġ ġ") for i in (3, 5, 6)]
    got = {r.doc_id: r.score for r in lm_score.lm_score_query(frame(rows), labels).collect()}
    assert got[2] < got[3]


def test_a_copy_is_known_by_the_other(frame):
    rare = " ".join(f"word{k}x{k * k}" for k in range(60))
    lone = " ".join(f"other{k}y{k * k}" for k in range(60))
    rows = [(1, rare), (2, rare), (3, lone)] + [(10 + i, f"the cat sat on the mat {i}") for i in range(20)]
    got = {r.doc_id: r.background_loss for r in word_model.score(frame(rows), F.lit(False)).collect()}
    assert got[1] == got[2] < got[3] - 1


def test_rows_of_entries_grow_with_the_corpus(frame, monkeypatch):
    """Blocks and ranges both grow with the root: four times the text is four times the rows, not sixteen."""
    for name, value in (("BLOCK", 64), ("RANGE", 128), ("ROW", 64), ("BLOCK_MOST", 1 << 20), ("RANGE_MOST", 1 << 20)):
        monkeypatch.setattr(word_model, name, value)
    seen, real = [], word_model._entries

    def counted(dealt, parts):
        out = real(dealt, parts)
        seen.append(out.count())
        return out

    monkeypatch.setattr(word_model, "_entries", counted)
    scores = []
    for n in (300, 1200):
        rows = [(k, " ".join(f"w{(k * 31 + j * j) % 997}" for j in range(12))) for k in range(n)]
        scores.append({r.doc_id: r.background_loss for r in word_model.score(frame(rows).coalesce(1), F.lit(False)).collect()})
        if n == 300:
            want = brute(rows, [False] * n)
            assert all(scores[0][k] == pytest.approx(w[2], abs=2e-6) for k, w in enumerate(want))
    assert len(scores[1]) == 1200 and 2 < seen[1] / seen[0] < 6
    for size in (1 << 30, 1 << 32, 1 << 34):
        monkeypatch.undo()
        joined, parts = word_model.layout(size, 8)
        assert size / (joined * word_model.BLOCK) * parts <= 3 * size / word_model.ROW
