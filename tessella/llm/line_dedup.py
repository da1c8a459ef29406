"""Line dedup by a sharded minimal perfect hash.

The keys to act on, those of lines held by several documents, are split by hash into shards
of bounded size. A shard is a minimal perfect hash (levels of bit arrays; a key's rank among
the set bits is its slot) with one array of fingerprints, one of counts and one of the
largest holder. Documents send 16-byte hashes of their lines, never the lines, to the
shard's task, which loads the arrays and streams the probes past them. A key with more than
CROWD * sqrt(all lines) holders would crowd one task: there are at most sqrt(all lines) /
CROWD such keys, and they form a shard that every task has, answered before the shuffle. So
with n lines neither a task's rows of one key nor that shard grow faster than sqrt(n).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.text import ascii_lower, whole
from tessella.plans.materialize import materialize

#: Keys in a shard, lines sent to a shard on average, and how many holders crowd a task.
MIN_CHARS, MIN_DOCS, SHARD_KEYS, SHARD_LINES, CROWD = 20, 3, 65_536, 1 << 20, 4
STRIP = " \t\n\x0b\x0c\r"
LEVELS, GAMMA = 48, 2.0
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    salt = np.uint64(int(_C1) * (level + 1) % 2**64)
    z = (h1 ^ (h2 * _C3)) + salt + h2
    z = (z ^ (z >> np.uint64(30))) * _C2
    z = (z ^ (z >> np.uint64(27))) * _C3
    return z ^ (z >> np.uint64(31))


class MinimalPerfectHash:
    """Slots 0..n-1 for n distinct 128-bit keys; other keys may get any slot or -1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.cumsum(bits, dtype=np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> MinimalPerfectHash:
        sizes, bits = [], []
        for level in range(LEVELS):
            if not len(h1):
                break
            m = max(16, int(GAMMA * len(h1)))
            at = (_mix(h1, h2, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            bits.append(alone)
            left = ~alone[at]
            h1, h2 = h1[left], h2[left]
        if len(h1):
            raise ValueError("keys are not distinct")
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), -1, np.int64)
        open_ = np.arange(len(h1))
        for level, m in enumerate(self.sizes):
            if not len(open_):
                break
            at = (_mix(h1[open_], h2[open_], level) % np.uint64(m)).astype(np.int64) + self.starts[level]
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]] - 1
            open_ = open_[~hit]
        return out

    def pack(self) -> tuple[bytes, bytes]:
        return self.sizes.tobytes(), np.packbits(self.bits).tobytes()

    @classmethod
    def unpack(cls, sizes: bytes, bits: bytes) -> MinimalPerfectHash:
        s = np.frombuffer(sizes, np.int64)
        return cls(s, np.unpackbits(np.frombuffer(bits, np.uint8), count=int(s.sum())).astype(bool))


class LineIndex:
    """The arrays of one shard: fingerprint, count and largest holder by slot."""

    def __init__(self, mph: MinimalPerfectHash, prints: np.ndarray, counts: np.ndarray, last: np.ndarray):
        self.mph, self.prints, self.counts, self.last = mph, prints, counts, last

    @classmethod
    def build(cls, h1, h2, counts, last) -> LineIndex:
        mph = MinimalPerfectHash.build(h1, h2)
        at = mph.slots(h1, h2)
        out = [np.empty(len(h1), t) for t in (np.uint64, np.uint32, np.int64)]
        for array, values in zip(out, (h2, np.minimum(counts, 2**32 - 1), last), strict=True):
            array[at] = values
        return cls(mph, *out)

    def pack(self) -> list[bytes]:
        return [*self.mph.pack(), self.prints.tobytes(), self.counts.tobytes(), self.last.tobytes()]

    @classmethod
    def unpack(cls, parts: list[bytes]) -> LineIndex:
        kinds = (np.uint64, np.uint32, np.int64)
        return cls(MinimalPerfectHash.unpack(*parts[:2]), *(np.frombuffer(p, t) for p, t in zip(parts[2:], kinds, strict=True)))

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (0 for a key that is not in the shard) and largest holders."""
        at = self.mph.slots(h1, h2)
        safe = np.maximum(at, 0)
        if not len(self.prints):
            return np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        held = (at >= 0) & (self.prints[safe] == h2)
        return np.where(held, self.counts[safe], 0), self.last[safe]


def lines(text: Column) -> Column:
    return F.split(whole(text), "\n")


def _hashed(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(doc, th, ls): per line its position and two hashes, for lines of min_chars or more."""
    keys = F.transform(lines(ascii_lower(F.col(text))), lambda x: F.btrim(x, F.lit(STRIP)))
    long = F.filter(F.transform(keys, lambda x, i: F.struct(i.alias("pos"), x.alias("x"))), lambda s: F.length(s["x"]) >= min_chars)
    found = F.transform(long, lambda s: F.struct(s["pos"].alias("pos"), F.xxhash64(s["x"]).alias("h1"), F.xxhash64(F.lit(1), s["x"]).alias("h2")))
    return docs.select(F.col(key).alias("id"), F.xxhash64(F.col(key)).alias("doc"), F.xxhash64(whole(F.col(text))).alias("th"), found.alias("ls"))


def _shards(keys: DataFrame) -> DataFrame:
    """One row per shard with its packed arrays, from (shard, h1, h2, n, last)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        parts = LineIndex.build(h1, h2, pdf["n"].to_numpy(np.int64), pdf["last"].to_numpy(np.int64)).pack()
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "parts": [parts]})

    return keys.groupBy("shard").applyInPandas(build, "shard int, parts array<binary>")


def _probing(heavy: list[bytes] | None, n_shards: int):
    """Answers heavy keys at once and deals the other probes to their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LineIndex.unpack(heavy) if heavy else None
        for b in batches:
            h1, h2, doc = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "doc"))
            kind = np.ones(len(h1), np.int8)
            shard = (h1.view(np.uint64) % np.uint64(n_shards)).astype(np.int32)
            keep = np.ones(len(h1), bool)
            if index:
                count, last = index.probe(h1.view(np.uint64), h2.view(np.uint64))
                held = count > 0
                keep = ~held | (doc != last)
                kind[held] = 2
                # By document and text, so that neither copies nor one text's lines meet.
                mixed = _mix(b.column("th").to_numpy().view(np.uint64), doc.view(np.uint64), 0)
                spread = mixed % np.uint64(n_shards)
                shard[held] = spread[held].astype(np.int32)
            out = [pa.array(shard[keep]), pa.array(kind[keep]), *(b.column(c).filter(pa.array(keep)) for c in ("doc", "th", "pos", "h1", "h2"))]
            parts = pa.nulls(int(keep.sum()), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([*out, parts], names=["shard", "kind", "doc", "th", "pos", "h1", "h2", "parts"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by shard: first the arrays of a shard, then all its probes, in batches."""
    index, at = None, None
    for b in batches:
        kind, shard = (b.column(c).to_numpy() for c in ("kind", "shard"))
        drop = kind == 2
        # Runs of one shard; its arrays, if it has any, come first.
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(shard)], strict=True):
            if lo == hi:
                continue
            if shard[lo] != at:
                index, at = None, shard[lo]
            if kind[lo] == 0:
                index = LineIndex.unpack(b.column("parts")[int(lo)].as_py())
            if index is None:
                continue
            mine = np.arange(lo, hi)[kind[lo:hi] == 1]
            h1, h2, doc = (b.column(c).to_numpy(zero_copy_only=False)[mine] for c in ("h1", "h2", "doc"))
            count, last = index.probe(h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64))
            drop[mine] = (count > 0) & (doc != last)
        kept = pa.array(drop)
        yield pa.RecordBatch.from_arrays([b.column(c).filter(kept) for c in ("doc", "th", "pos")], names=["doc", "th", "pos"])


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(doc, th, drops): positions of the lines to drop, by hashes of the key and of the text.

    Keys may be of any type that has an order. A null key is less than any other, so its
    document loses lines to all others. Rows that share the largest key all keep a line.
    """
    spark = docs.sparkSession
    found = materialize(_hashed(docs, key, text, min_chars), "lines")
    per_doc = found.select("id", F.explode(F.array_distinct(F.transform("ls", lambda s: F.struct(s["h1"].alias("h1"), s["h2"].alias("h2"))))).alias("k"))
    keys = per_doc.groupBy("k.h1", "k.h2").agg(F.count("*").alias("n"), F.max("id").alias("last")).filter(F.col("n") >= min_docs)
    keys = materialize(keys.withColumn("last", F.xxhash64("last")), "keys")
    size = keys.agg(F.count("*").alias("keys")).first()["keys"]
    total = found.agg(F.coalesce(F.sum(F.size("ls")), F.lit(0)).alias("n")).first()["n"]
    n_shards = max(-(-size // shard_keys), -(-total // SHARD_LINES), int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # At most sqrt(total) / CROWD heavy keys of some 22 bytes: 4 MB for 10**12 lines.
    crowd = int(CROWD * math.sqrt(total))
    packed = _shards(keys.filter(F.col("n") > crowd).withColumn("shard", F.lit(0))).collect()
    heavy = [bytes(p) for p in packed[0]["parts"]] if packed else None
    # Unsigned remainder, as in the task: the shift leaves 63 bits, so no sign is in the way.
    half, bit = F.shiftrightunsigned("h1", 1), F.col("h1").bitwiseAND(F.lit(1))
    unsigned = ((half % n_shards) * 2 + bit) % n_shards
    light = keys.filter(F.col("n") <= crowd).withColumn("shard", unsigned.cast("int"))
    kind = "shard int, kind tinyint, doc long, th long, pos int, h1 long, h2 long, parts array<binary>"
    arrays = _shards(light).select("shard", F.lit(0).cast("tinyint").alias("kind"), *[F.lit(0).cast(t).alias(c) for c, t in (("doc", "long"), ("th", "long"), ("pos", "int"), ("h1", "long"), ("h2", "long"))], "parts")
    probes = found.select("doc", "th", F.explode("ls").alias("l")).select("doc", "th", "l.pos", "l.h1", "l.h2")
    probes = probes.mapInArrow(_probing(heavy, n_shards), kind)
    dealt = arrays.unionByName(probes).repartition(n_shards, "shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(_answer, "doc long, th long, pos int").groupBy("doc", "th").agg(F.collect_set("pos").alias("drops"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """``docs`` with ``text`` without its dropped lines, and the columns n_lines and n_dropped.

    A line's key is the line without blanks at either end, A-Z in lower case. Keys of
    min_chars or more in min_docs documents or more lose their lines in all documents but
    the one with the largest key. Each row is a document, repeated rows too. A null text is
    one empty line and becomes empty. Columns of ``docs`` named n_lines or n_dropped are
    replaced; all others pass through.
    """
    others = [c for c in docs.columns if c in (key, text) or c not in ("n_lines", "n_dropped")]
    docs = docs.select(*[F.col(f"`{c}`") for c in others])
    drops = dropped_lines(docs, key, text, **limits).withColumnsRenamed({"doc": "__doc", "th": "__th", "drops": "__drops"})
    doc, th = F.xxhash64(F.col(key)), F.xxhash64(whole(F.col(text)))
    held = docs.withColumns({"__d": doc, "__t": th})
    joined = held.join(drops, (F.col("__d") == F.col("__doc")) & (F.col("__t") == F.col("__th")), "left").withColumn("__lines", lines(F.col(text)))
    n = F.size("__lines")
    gone = F.coalesce("__drops", F.array().cast("array<int>"))
    left = F.array_except(F.sequence(F.lit(0), n - 1), gone)
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("__lines"), i)), "\n")
    whole_text = F.when(F.size(gone) == 0, whole(F.col(text))).otherwise(kept)
    return joined.select(
        *[whole_text.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], n.cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped")
    )


def line_dedup_query(documents: DataFrame) -> DataFrame:
    out = dedup_lines(documents.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {MIN_DOCS}),
g AS (SELECT k.r, k.i, k.line, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c ON k.key = c.key),
o AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM o JOIN d USING (r)"""
