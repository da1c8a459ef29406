"""SimHash near-duplicates with bit-sliced comparison.

The 64 bits are cut into blocks; fingerprints that differ in at most RADIUS = 3 bits agree in
all blocks but three, so every choice of the others is a key: 4 keys of 16 bits, or 10 of 25
or 20 of 32 where that is needed to keep about GROUP fingerprints to a key. A key with over
CHUNK is split without loss: of four parts of the remaining bits, one agrees. What is still
larger is cut into chunks and every pair of chunks is its own task. In a task the members
stand as bit planes: word j of plane k holds bit k of members 64j..64j+63. Against a block of
queries, each plane is XORed in and a carry-save counter (two bits and an overflow mark)
updates 64 distances per machine word; columns whose distances have all passed the radius
are left out, and the block is given up once none is left. A task returns a spanning forest
of its links, not the pairs.

``similar_groups`` asks for a similarity of shingle sets instead. Three bits hold only the
closest copies, so there the comparison finds candidates at WIDE bits among documents that
share minimum hashes, and every link is then checked by the exact Jaccard of the sets.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.text import ascii_lower, let, whole, words
from tessella.operators.components import connected_components
from tessella.plans.materialize import materialize

RADIUS, GROUP, CHUNK, QUERIES = 3, 512, 4096, 256
#: Row b: the eight bits of byte b, each in a byte lane of its own.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def shingle_hashes(text: Column, n: int = 3) -> Column:
    """XXH64 (seed 42) of every n-word shingle of the whole text, repeats included."""

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + j) for j in range(n)])))
        few = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) >= n, many).when(F.size(w) > 0, few).otherwise(F.array().cast("array<bigint>"))

    return let(words(ascii_lower(whole(text))), of)


def majority(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per list: bits that are set in over half of its values; an empty list gives 0.

    A byte's bits are looked up as eight byte lanes and added up to 255 at a time.
    """
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    blocks = -(-sizes[full] // 255)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    within = np.arange(blocks.sum()) - np.repeat(first, blocks)
    starts = np.repeat(offsets[:-1][full] - offsets[0], blocks) + 255 * within
    octets = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)
    for k in range(8):
        # Lists stand one behind the other, so each block ends where the next begins.
        lanes = np.add.reduceat(_LANES[octets[:, k]], starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits = (2 * counts > sizes[full][:, None]).astype(np.uint64)
        out[full] |= (bits << np.arange(8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(8 * k)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("hashes")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        fp = majority(values, offsets).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(fp)], names=["doc", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc, fp) for every row; texts without words have fingerprint 0."""
    hashed = docs.select(F.col(key).alias("doc"), shingle_hashes(F.col(text), shingle).alias("hashes"))
    return hashed.mapInArrow(_fingerprints, f"doc {dict(docs.dtypes)[key]}, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit k of member i is bit i % 64 of word i // 64 of row k."""
    pad = -len(fps) % 64
    padded = np.concatenate([fps, np.zeros(pad, np.uint64)])
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near_pairs(queries: np.ndarray, members: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, member) at up to ``radius`` differing bits.

    A counter of ``bits`` planes starts so far up that it overflows at radius + 1.
    """
    if not 0 <= radius < 64:
        raise ValueError("a radius lies in 0..63")
    bits = radius.bit_length()
    lead = (1 << bits) - 1 - radius
    plane = planes(members)
    valid = np.full(plane.shape[1], ~np.uint64(0))
    if len(members) % 64:
        valid[-1] = np.uint64((1 << (len(members) % 64)) - 1)
    zero, ones = np.uint64(0), ~np.uint64(0)
    left, right = [], []
    for lo in range(0, len(queries), QUERIES):
        block = queries[lo : lo + QUERIES]
        cols = np.arange(plane.shape[1])
        counter = [np.full((len(block), len(cols)), ones if lead >> k & 1 else zero) for k in range(bits)]
        over = np.broadcast_to(~valid, (len(block), len(cols))).copy()
        for k in range(64):
            mask = np.where((block >> np.uint64(k)) & np.uint64(1), ones, zero)[:, None]
            carry = plane[k, cols] ^ mask
            for c in counter:
                up = c & carry
                c ^= carry
                carry = up
            over |= carry
            if k % 8 == 7 and k < 63:
                live = (over != ones).any(axis=0)
                if not live.any():
                    break
                if live.sum() < 0.75 * len(cols):
                    cols, over = cols[live], over[:, live]
                    counter = [c[:, live] for c in counter]
        else:
            q, w = np.nonzero(over != ones)
            hits = np.unpackbits((~over[q, w])[:, None].view(np.uint8), axis=1, bitorder="little")
            i, bit = np.nonzero(hits)
            left.append(q[i] + lo)
            right.append(cols[w[i]] * 64 + bit)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable index of each of n nodes under the links (a, b)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            return label


def _by_task(solve: Callable[[dict[str, np.ndarray]], pa.RecordBatch | None]):
    """Rows sorted by task: ``solve`` gets the columns of one task after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def told() -> Iterator[pa.RecordBatch]:
            out = solve({c: np.concatenate([h[c] for h in held]) for c in held[0]})
            if out is not None:
                yield out

        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            task = columns["task"]
            if not len(task):
                continue
            cuts = np.flatnonzero(np.diff(task)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(task)], strict=True):
                if held and task[lo] != at:
                    yield from told()
                    held = []
                at = task[lo]
                held.append({c: v[lo:hi] for c, v in columns.items()})
        if held:
            yield from told()

    return run


def _compared(rows: dict[str, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a task's two chunks, or of its one, at up to ``radius`` bits."""
    fp = rows["fp"].view(np.uint64)
    first, second = (np.flatnonzero(rows["chunk"] == rows[c][0]) for c in ("lo", "hi"))
    a, b = near_pairs(fp[first], fp[second], radius)
    return first[a], second[b]


def _linking(radius: int):
    def solve(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        label = forest(len(rows["fp"]), *_compared(rows, radius))
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(rows["rep"][linked]), pa.array(rows["rep"][label[linked]])], names=["a", "b"])

    return _by_task(solve)


def tasks(nodes: DataFrame, parts: Callable[[Column], Column], chunk: int = CHUNK) -> DataFrame:
    """(task, lo, hi, chunk, k, ...): ``nodes`` (rep, fp, keys, ...) dealt to the tasks that compare them.

    Nodes that share key number k meet. Only (rep, k, key) is shuffled to find shared keys.
    Where over ``chunk`` nodes share one, it is replaced by the array of keys that ``parts``
    makes of a node and k; what is still larger is cut into chunks, one task a pair of them.
    """
    own = [c for c in nodes.columns if c != "keys"]
    dealt = nodes.select("rep", F.posexplode("keys").alias("k", "key"))
    # Written, so that both sides of the join are plain and a hot key's rows can be split.
    sizes = materialize(dealt.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    met = dealt.join(sizes, "key").join(nodes.select(*own), "rep")
    if not sizes.filter(F.col("n") > chunk).isEmpty():
        split = met.filter(F.col("n") > chunk).drop("n").withColumn("part", F.explode(parts(F.col("k"))))
        split = materialize(split.withColumn("key", F.xxhash64("key", "part")).drop("part"), "split")
        fewer = materialize(split.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
        met = met.filter(F.col("n") <= chunk).unionByName(split.join(fewer, "key"))
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    met = met.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    pairs = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pairs = pairs.withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")})
    return pairs.withColumn("task", F.xxhash64("key", "lo", "hi")).select("task", "lo", "hi", "chunk", "k", *own)


def by_task(dealt: DataFrame) -> DataFrame:
    n = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return dealt.repartition(n, "task").sortWithinPartitions("task")


def links(nodes: DataFrame, masks: list[int], chunk: int = CHUNK) -> DataFrame:
    """(a, b): a spanning set of the links at RADIUS bits between nodes (rep, fp)."""
    keyed = nodes.withColumn("keys", F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(masks)]))

    def parts(k: Column) -> Column:
        choice = F.lit(None)
        for i, m in enumerate(masks):
            choice = F.when(k == i, F.array(*[F.xxhash64(F.lit(j), F.col("fp").bitwiseAND(F.lit(_signed(x)))) for j, x in enumerate(rest(m))])).otherwise(choice)
        return choice

    kind = dict(nodes.dtypes)["rep"]
    dealt = tasks(keyed, parts, chunk).select("task", "lo", "hi", "chunk", "fp", "rep")
    return by_task(dealt).mapInArrow(_linking(RADIUS), f"a {kind}, b {kind}")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def rest(mask: int, parts: int = RADIUS + 1) -> list[int]:
    """The bits that are not in ``mask``, in ``parts`` masks."""
    bits = [b for b in range(64) if not mask >> b & 1]
    return [sum(1 << b for b in bits[j::parts]) for j in range(parts)]


def key_masks(n: int, group: int = GROUP) -> list[int]:
    """Masks of which any two fingerprints at RADIUS bits agree in one, for n fingerprints.

    With few fingerprints one key, or leading parts of four blocks, already keeps to ``group``.
    """
    need = math.ceil(math.log2(max(1, n) / group)) if n > group else 0
    if not need:
        return [0]
    for blocks in range(RADIUS + 1, 7):
        edges = [64 * k // blocks for k in range(blocks + 1)]
        whole = [[b for b in range(edges[k], edges[k + 1])] for k in range(blocks)]
        clean = blocks - RADIUS
        chosen = [[b for k in c for b in whole[k]] for c in itertools.combinations(range(blocks), clean)]
        if min(map(len, chosen)) >= need or blocks == 6:
            break
    return [sum(1 << b for b in (bits[:need] if blocks == RADIUS + 1 else bits)) for bits in chosen]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fingerprint, component_id) per row; component_id is the least key reachable.

    Null and empty texts have fingerprint 0 and are linked like any other. Equal
    fingerprints are one node, so copies are never paired; repeated rows each get their
    row. Rows with a null key get their component from the others, and null if alone.
    """
    fps = materialize(fingerprints(docs, key, text, shingle), "fingerprints")
    reps = materialize(fps.groupBy("fp").agg(F.min("doc").alias("rep")), "reps")
    found = connected_components(links(reps.filter("rep is not null"), key_masks(reps.count()))).withColumnRenamed("node", "rep")
    nodes = reps.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = fps.join(nodes, "fp")
    return out.select(F.col("doc").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- by similarity

#: Minimum hashes per document, one byte each kept; bands of ROWS of them are keys; nodes in a
#: chunk; keys of two further hashes that replace a hot one.
HASHES, ROWS, KEYS, WIDE, SET_CHUNK, PARTS = 256, 3, 16, 22, 1024, 12
_ODD = (np.random.default_rng(64).integers(0, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprint, signature and keys; a document without words has no keys."""
    for b in batches:
        lists = b.column("hashes")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]).view(np.uint64)
        fp = majority(values.view(np.int64), offsets).view(np.int64)
        full = np.flatnonzero(np.diff(offsets))
        sig = np.zeros((b.num_rows, HASHES), np.uint8)
        keys = np.zeros((b.num_rows, KEYS), np.uint64)
        if len(full):
            starts = offsets[:-1][full] - offsets[0]
            for j, odd in enumerate(_ODD):
                z = values * odd
                z ^= z >> np.uint64(32)
                low = np.minimum.reduceat(z, starts)
                low = low * np.uint64(0x9E3779B97F4A7C15)
                sig[full, j] = (low >> np.uint64(56)).astype(np.uint8)
                if j < KEYS * ROWS:
                    k = j // ROWS
                    keys[full, k] = (keys[full, k] ^ (low >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k)
        counts = np.zeros(b.num_rows, np.int32)
        counts[full] = KEYS
        at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(at), pa.array(keys[full].ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(fp), pa.array([r.tobytes() for r in sig], pa.binary()), listed], names=["doc", "fp", "sig", "keys"])


def _pairs(rows: dict[str, np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, agreeing bytes) of a task's candidates that share no earlier key."""
    a, b = _compared(rows, WIDE)
    a, b = a[upper := a != b], b[upper]
    sigs = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(-1, HASHES)
    agree = np.zeros(len(a), np.int64)
    fresh = np.ones(len(a), bool)
    k = int(rows["k"][0])
    for lo in range(0, len(a), 65_536):
        part = slice(lo, lo + 65_536)
        same = sigs[a[part]] == sigs[b[part]]
        agree[part] = same.sum(axis=1)
        fresh[part] = ~same[:, : k * ROWS].reshape(len(same), k, ROWS).all(axis=2).any(axis=1)
    good = (agree >= least) & fresh
    a, b, agree = a[good], b[good], agree[good]
    if rows["lo"][0] == rows["hi"][0]:
        a, b, agree = a[one := a < b], b[one], agree[one]
    return a, b, agree


def _candidates(least: int, kind: pa.DataType):
    """The rows of a task that are one of a candidate pair."""

    def solve(rows: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        a, b, _ = _pairs(rows, least)
        if not len(a):
            return None
        at = np.unique(np.concatenate([a, b]))
        kinds = {"task": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "chunk": pa.int32(), "k": pa.int32(), "fp": pa.int64(), "sig": pa.binary(), "rep": kind}
        return pa.RecordBatch.from_arrays([pa.array(rows[c][at], t) for c, t in kinds.items()], names=list(kinds))

    return _by_task(solve)


def verified(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[int]:
    """Indices of pairs whose sets are alike, enough of them to join all that the pairs can.

    The pairs stand best first. Each round checks the first open pair of every group so
    far; a pair is left out once its ends are in one group, and only then.
    """
    label, open_, good = np.arange(len(sets)), np.arange(len(a)), []
    while True:
        open_ = open_[label[a[open_]] != label[b[open_]]]
        if not len(open_):
            return good
        first = np.full(len(sets), len(a))
        for end in (a, b):
            np.minimum.at(first, label[end[open_]], open_)
        pick = np.unique(first[first < len(a)])
        passed = []
        for k in pick.tolist():
            x, y = sets[a[k]], sets[b[k]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                passed.append(k)
        good += passed
        joined = forest(len(sets), a[good], b[good])
        label, open_ = joined, np.setdiff1d(open_, pick, assume_unique=True)


def _checking(least: int, similarity: float):
    def solve(rows: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        a, b, agree = _pairs(rows, least)
        order = np.argsort(-agree, kind="stable")
        a, b = a[order], b[order]
        good = verified(a, b, [np.frombuffer(x, np.uint64) for x in rows["set"]], similarity)
        return pa.RecordBatch.from_arrays([pa.array(rows["rep"][a[good]]), pa.array(rows["rep"][b[good]])], names=["a", "b"]) if good else None

    return _by_task(solve)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprint and sorted distinct hashes."""
    for b in batches:
        lists = b.column("hashes")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]).view(np.uint64)
        fp = majority(values.view(np.int64), offsets).view(np.int64)
        at = offsets - offsets[0]
        blobs = [np.sort(values[x:y]).tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(fp), pa.array(blobs, pa.binary())], names=["doc", "fp", "set"])


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, component_id): groups of documents linked by shingle sets that are ``similarity`` alike.

    Documents that share one of KEYS bands of minimum hashes (at 0.8, all but one pair in
    100,000 do) are compared bit-sliced at WIDE bits of fingerprints of their distinct
    shingles; 0.8 is some 10 bits, four deviations below. Pairs whose signatures agree in
    ``similarity`` of the bytes less 4.5 deviations are candidates; the exact Jaccard of
    their sets decides. Documents with one fingerprint and one signature are one node.
    Documents without words are one group; other cases are as for ``near_duplicates``.
    """
    kind = docs.schema[key].dataType
    name = kind.simpleString()

    def hashed(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(key).alias("doc"), F.array_distinct(shingle_hashes(F.col(text), shingle)).alias("hashes"))

    sketched = materialize(hashed(docs).mapInArrow(_sketches, f"doc {name}, fp long, sig binary, keys array<long>"), "sketches")
    reps = materialize(sketched.groupBy("fp", "sig").agg(F.min("doc").alias("rep"), F.min("keys").alias("keys")), "reps")
    least = int(HASHES * (similarity - 4.5 * math.sqrt(similarity * (1 - similarity) / HASHES)))
    begin = KEYS * ROWS + 1
    further = F.array(*[F.xxhash64(F.lit(j), F.substring("sig", begin + 2 * j, 2)) for j in range(PARTS)])
    columns = ("task", "lo", "hi", "chunk", "k", "fp", "sig", "rep")
    dealt = by_task(tasks(reps.filter("rep is not null"), lambda k: further, SET_CHUNK).select(*columns))
    near = materialize(dealt.mapInArrow(_candidates(least, to_arrow_type(kind)), f"task long, lo int, hi int, chunk int, k int, fp long, sig binary, rep {name}"), "near")
    wanted = near.select("rep").distinct()
    sets = hashed(docs.join(wanted, docs[key] == wanted["rep"], "left_semi")).mapInArrow(_sets, f"doc {name}, fp long, set binary")
    sets = sets.groupBy(F.col("doc").alias("rep"), "fp").agg(F.min("set").alias("set"))
    found = by_task(near.join(sets, ["rep", "fp"])).select(*columns, "set").mapInArrow(_checking(least, similarity), f"a {name}, b {name}")
    found = connected_components(found).withColumnRenamed("node", "rep")
    nodes = reps.join(found, "rep", "left").select("fp", "sig", F.coalesce("component", "rep").alias("component_id"))
    return sketched.select("doc", "fp", "sig").join(nodes, ["fp", "sig"]).select(F.col("doc").alias(key), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs`` whose key is the least of its group, all columns as they are."""
    found = similar_groups(docs, key, text, shingle, similarity)
    first = found.filter(F.col(key).isNull() | (F.col(key) == F.col("component_id"))).select(F.col(key).alias("__first")).distinct()
    return docs.join(first, docs[key].eqNullSafe(first["__first"]), "left_semi")
