"""Packing into optimal length buckets.

One histogram of lengths over the whole corpus, at most ``max_len`` bins, goes to a dynamic
program that picks the bucket boundaries with the least padding. Each sequence is padded to
its bucket's boundary, and batches of as many sequences as the token budget holds are formed
inside each bucket. A row names the range of its text's tokens; ``with_tokens`` lays them out.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.text import words
from tessella.plans.materialize import materialize

MAX_LEN, BUCKETS, BUDGET = 2048, 16, 65_536


def word_count(text: Column) -> Column:
    return F.size(words(text))


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Ascending bucket boundaries, ``buckets`` at most, with the least total padding.

    The cost of a bucket (i, j] is its boundary lengths[j] times the sequences in it; the
    tokens themselves cost the same whatever the buckets. Ties take the leftmost cut.
    """
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(lengths)
    if not n:
        return []
    upto = np.concatenate([[0], np.cumsum(counts)])
    best = upto[1:] * lengths
    cuts = []
    for _ in range(min(buckets, n) - 1):
        # A last bucket over bins i..j after the best split of the bins before i.
        cost = np.where(np.arange(n)[:, None] > np.arange(n)[None, :], np.iinfo(np.int64).max, 0)
        tail = (upto[None, 1:] - upto[:-1, None]) * lengths[None, :]
        before = np.concatenate([[0], best[:-1]])
        total = np.where(cost == 0, before[:, None] + tail, cost)
        pick = total.argmin(axis=0)
        cuts.append(pick)
        best = total[pick, np.arange(n)]
    out, j = [], n - 1
    for pick in reversed(cuts):
        out.append(int(lengths[j]))
        j = int(pick[j]) - 1
        if j < 0:
            break
    else:
        out.append(int(lengths[j]))
    return sorted(out)


def chunks(docs: DataFrame, key: str, tokens: Column, max_len: int) -> DataFrame:
    """(key, chunk, start, n_tokens): a text over ``max_len`` tokens is cut into several sequences."""
    n = F.greatest(F.size(tokens), F.lit(0))
    counted = docs.select(F.col(key), n.alias("__n"))
    last = F.greatest(F.ceil(F.col("__n") / max_len) - 1, F.lit(0)).cast("int")
    cut = counted.select(key, "__n", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    start = F.col("chunk") * max_len
    return cut.select(key, "chunk", start.alias("start"), F.least(F.col("__n") - start, F.lit(max_len)).alias("n_tokens"))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, tokens: Column | None = None) -> DataFrame:
    """Per sequence: key, chunk, start, n_tokens, bucket (its boundary), batch, slot.

    Tokens are the text's words, or the array ``tokens``, which any tokenizer may have made;
    a sequence holds those from ``start`` on. Sequences of a bucket are numbered by (hash
    cell, key, chunk) without a gap, so every batch but a bucket's last is full; the number
    splits into batch and slot. Null and empty texts are sequences of no tokens, in the
    least bucket. Repeated rows are packed each; which of them gets which slot is not
    defined. Other columns are not read. Of n sequences no task numbers much more than
    sqrt(n), and the cells' counts, which all tasks have, are sqrt(n) rows too.
    """
    if budget < max_len:
        raise ValueError("a batch must hold the longest sequence")
    cut = materialize(chunks(docs, key, words(F.col(text)) if tokens is None else tokens, max_len), "chunks")
    # At most max_len + 1 rows.
    histogram = cut.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()
    lengths, counts = (np.array([r[c] for r in histogram], np.int64) for c in ("n_tokens", "n"))
    edges = boundaries(lengths, counts, buckets) or [0]
    bucket = F.element_at(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e >= F.col("n_tokens")), 1)
    # Cells of a bucket by its share of the rows.
    room = max(1, math.isqrt(int(counts.sum())))
    held = np.bincount(np.searchsorted(edges, lengths), weights=counts, minlength=len(edges)) if len(counts) else [0]
    cells = F.element_at(F.create_map(*[F.lit(int(x)) for e, n in zip(edges, held, strict=True) for x in (e, max(1, math.ceil(n / room)))]), F.col("bucket"))
    placed = cut.withColumn("bucket", bucket).withColumn("cell", F.pmod(F.xxhash64(F.col(key), F.col("chunk")), cells).cast("int"))
    # At most sqrt(n) + buckets rows of 20 bytes: 20 MB for 10**12 sequences.
    sizes = placed.groupBy("bucket", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(_upto("bucket", "cell")) - F.col("n")
    offsets = F.broadcast(sizes.select("bucket", "cell", before.alias("before")))
    inside = F.row_number().over(_upto(["bucket", "cell"], [F.col(key), F.col("chunk")])) - 1
    place = F.col("before") + F.col("inside")
    slots = F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1)))
    out = placed.withColumn("inside", inside).join(offsets, ["bucket", "cell"])
    return out.select(key, "chunk", "start", "n_tokens", "bucket", F.floor(place / slots).alias("batch"), F.pmod(place, slots).alias("slot"))


def with_tokens(packed: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", tokens: Column | None = None) -> DataFrame:
    """``packed`` with ``tokens``, the words of each sequence; ``docs`` must not repeat a key."""
    held = docs.select(F.col(key).alias("__key"), (words(F.col(text)) if tokens is None else tokens).alias("__tokens"))
    joined = packed.join(held, packed[key].eqNullSafe(held["__key"]))
    return joined.select(*packed.columns, F.slice("__tokens", F.col("start") + 1, F.col("n_tokens")).alias("tokens"))


def _upto(part, order):
    return Window.partitionBy(part).orderBy(order)
