"""Anchors among equal hashes."""

import hashlib

import numpy as np
from test_dedup import brute_bytes

from tessella.llm import suffix_dedup as sd


def test_the_leftmost_of_equal_values_is_taken():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 4, 9000, dtype=np.uint64) << np.uint64(20)
    for run in (1, 7, 153, 256):
        want = [s + int(np.argmin(h[s : s + run])) for s in range(len(h) - run + 1)]
        assert sd._window_minima(h, run).tolist() == want


def test_short_periods_at_any_place(frame):
    rng = np.random.default_rng(4)
    noise = lambda n: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, n))
    rows = [(i, noise(at) + stretch + noise(300)) for i, (at, stretch) in enumerate([(3950, "-" * 230), (100, "+" * 230), (3900, "over and over " * 17), (8050, "=~" * 120)])]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in sd.remove_repeats(frame(rows).select("doc_id", "text")).collect()]
    want = brute_bytes(rows)
    assert sorted(got) == sorted(want) and all(w[2] for w in want)
