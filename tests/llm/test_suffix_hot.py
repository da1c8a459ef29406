"""A passage with many different surroundings, over several shards."""

import hashlib

import numpy as np
import pytest
from test_dedup import brute_bytes

from tessella.llm import suffix_dedup as sd


def test_a_bucket_sends_each_window_once():
    rng = np.random.default_rng(5)
    passage = rng.integers(97, 123, 260, dtype=np.uint8).tobytes()
    texts = [rng.integers(97, 123, 30, dtype=np.uint8).tobytes()[:-1] + bytes([128 + k]) + passage for k in range(50)]
    ids = np.stack([np.ones(50, np.int64), np.arange(50), np.arange(50)])
    _, region, _, first, last, n, h1, h2 = sd.solve_bucket(ids, texts, np.ones(50), np.ones(50, bool), 8)
    sent = n > 0
    assert len(set(zip(h1[sent].tolist(), h2[sent].tolist()))) == sent.sum() == len({t[s : s + 200] for t in texts for s in range(len(t) - 199)})
    assert (n[sent] == 2).sum() == 61 and h1[n == -1].tolist() > [0]
    assert sorted(zip(first[n == 0].tolist(), last[n == 0].tolist())) == [(30, 90)] * 50


@pytest.mark.parametrize("bucket", [1, 5])
def test_hot_passage(frame, bucket):
    rng = np.random.default_rng(6)
    noise = lambda n: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, n))
    passage, edge = noise(240), noise(30)
    rows = [(i, noise(60) + (edge if i % 5 == 0 else "") + passage + noise(60)) for i in range(40)]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in sd.remove_repeats(frame(rows).select("doc_id", "text"), bucket_regions=bucket).collect()]
    assert sorted(got) == sorted(brute_bytes(rows))
