"""The prefix trie of conversations, by adaptive radix trees.

A turn's id is fixed in width: 16 bytes of a hash of role and text. A conversation is the
string of its turns' ids, and a prefix of it at a multiple of 16 bytes is a node of the trie.

1. Conversations are rebuilt, equal ones become one key with a count, a smallest id and a
   digest of all their ids.
2. Keys are sorted by range over the whole corpus. A run of neighbours in this order goes
   into one adaptive radix tree: inner nodes of 4, 16, 48 or 256 places that grow when full,
   with common bytes kept as a path. As the order splits between any two keys, also below
   one turn, no turn is too common for it.
3. A tree gives out nodes at turn-aligned depths only. Nodes on the way to a run's first or
   last key may go on in the next run: of these each run gives its share, shares are summed
   by prefix, and what two neighbouring runs both counted is taken off once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.materialize import materialize

WIDTH, SHARED = 16, 5
#: Characters of joined ids in one row while they are gathered.
CHUNK_CHARS = 1 << 16
#: Keys in a range on average, and copies of a row of shares so that its children spread.
RANGE_KEYS, SALTS = 50_000, 16
NOTHING = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- the tree


class Node4:
    """Up to four (or, as Node16, sixteen) children by sorted bytes."""

    __slots__ = ("keys", "kids")
    room = 4

    def __init__(self, keys: bytearray | None = None, kids: list | None = None):
        self.keys, self.kids = keys or bytearray(), kids or []

    def get(self, byte: int):
        i = self.keys.find(byte)
        return self.kids[i] if i >= 0 else None

    def put(self, byte: int, kid) -> Node4 | Node48 | Node256:
        """The layout that has the child: this one, or a larger one if it was full."""
        i = self.keys.find(byte)
        if i >= 0:
            self.kids[i] = kid
            return self
        if len(self.keys) == self.room:
            return self.grown().put(byte, kid)
        at = sum(k < byte for k in self.keys)
        self.keys.insert(at, byte)
        self.kids.insert(at, kid)
        return self

    def grown(self):
        return Node16(self.keys, self.kids)

    def children(self):
        return iter(self.kids)


class Node16(Node4):
    __slots__ = ()
    room = 16

    def grown(self):
        return Node48(zip(self.keys, self.kids, strict=True))


class Node48:
    """A byte's place among up to 48 children."""

    __slots__ = ("kids", "place")

    def __init__(self, pairs):
        self.place, self.kids = bytearray(256), []
        for byte, kid in pairs:
            self.put(byte, kid)

    def get(self, byte: int):
        at = self.place[byte]
        return self.kids[at - 1] if at else None

    def put(self, byte: int, kid) -> Node48 | Node256:
        at = self.place[byte]
        if at:
            self.kids[at - 1] = kid
            return self
        if len(self.kids) == 48:
            return Node256((b, self.get(b)) for b in range(256)).put(byte, kid)
        self.kids.append(kid)
        self.place[byte] = len(self.kids)
        return self

    def children(self):
        return (self.kids[at - 1] for at in self.place if at)


class Node256:
    """A child for every byte."""

    __slots__ = ("kids",)

    def __init__(self, pairs):
        self.kids = [None] * 256
        for byte, kid in pairs:
            self.kids[byte] = kid

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, kid) -> Node256:
        self.kids[byte] = kid
        return self

    def children(self):
        return (k for k in self.kids if k is not None)


@dataclass(slots=True)
class Branch:
    """Bytes ``start`` to ``stop`` of the key of number ``no``, what ends behind them, and what goes on."""

    key: bytes
    no: int
    start: int
    stop: int
    value: int | None = None
    layout: Node4 | Node48 | Node256 | None = None


def _common(a: bytes, b: bytes, at: int, stop: int) -> int:
    """First place from ``at`` on where a and b differ, ``stop`` at most."""
    stop = min(stop, len(a), len(b))
    if a[at:stop] == b[at:stop]:
        return stop
    while at < stop:
        middle = at + (stop - at + 1) // 2
        if a[at:middle] == b[at:middle]:
            at = middle
        elif middle == at + 1:
            return at
        else:
            stop = middle
    return at


class Tree:
    """Adaptive radix tree from keys to their numbers."""

    def __init__(self):
        self.root = Branch(b"", -1, 0, 0)

    def insert(self, key: bytes, value: int) -> None:
        node, above, byte = self.root, None, 0
        while True:
            at = _common(key, node.key, node.start, node.stop)
            if at < node.stop:
                # The path parts here: a shorter one, with the old end as a child.
                upper = Branch(node.key, node.no, node.start, at)
                node.start = at
                upper.layout = Node4().put(node.key[at], node)
                above.layout = above.layout.put(byte, upper)
                node = upper
            if at == len(key):
                node.value = value
                return
            kid = node.layout.get(key[at]) if node.layout else None
            if kid is None:
                node.layout = (node.layout or Node4()).put(key[at], Branch(key, value, at, len(key), value))
                return
            node, above, byte = kid, node, key[at]


# ---------------------------------------------------------------- a run of keys


@dataclass(slots=True)
class Share:
    """What lies below a place in a tree: members, the least, leaves, saved bytes, nodes right below it."""

    n: int = 0
    least: int | None = None
    leaves: int = 0
    saved: int = 0
    tops: list[int] = field(default_factory=list)

    def add(self, other: Share) -> None:
        self.n += other.n
        self.least = other.least if self.least is None or other.least < self.least else self.least
        self.leaves += other.leaves
        self.saved += other.saved
        few, many = sorted((self.tops, other.tops), key=len)
        many.extend(few)
        self.tops = many


COLUMNS = {
    "node": pa.binary(), "parent": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(),
    "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "first": pa.binary(), "last": pa.binary(), "sizes": pa.list_(pa.int64()),
}
_DDL = "node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, first binary, last binary, sizes array<long>"


def _prefixes(key: bytes) -> list[bytes]:
    """A digest of every turn-aligned prefix, the empty one first."""
    state = hashlib.blake2b(digest_size=16)
    out = [state.digest()]
    for at in range(0, len(key), WIDTH):
        state.update(key[at : at + WIDTH])
        out.append(state.digest())
    return out


def run_nodes(keys: list[bytes], counts: list[int], leasts: list[int], sizes: list[list[int]], ends: list[str]) -> list[list]:
    """Rows of COLUMNS for a run of sorted distinct keys.

    A row has ``node``, the digest of its prefix, if other runs may share it; only then is
    the row a share. Of other rows those whose parent is such a one have ``parent``. The
    last row holds the run's first and last key and the sizes of the last one's turns.
    """
    tree = Tree()
    for i, key in enumerate(keys):
        tree.insert(key, i)
    edges = [(k, _prefixes(k)) for k in (keys[0], keys[-1])]
    rows: list[list] = []

    def emit(branch: Branch, at: int, below: Share, digest: bytes | None) -> Share:
        """The node that ends at byte ``at`` of the branch, and what it gives upwards."""
        if not below.tops:
            below.leaves = 1
        if at:
            below.saved += (below.n - 1) * sizes[branch.no][at // WIDTH - 1]
        ending = ends[branch.value] if branch.value is not None and at == branch.stop else None
        rows.append([digest, None, below.least, at // WIDTH, None, below.n, len(below.tops), below.leaves, below.saved, ending, None, None, None])
        for kid in below.tops:
            rows[kid][1 if digest is not None else 4] = digest if digest is not None else below.least
        return Share(below.n, below.least, below.leaves, below.saved, [len(rows) - 1])

    def opened(branch: Branch, above: list[int]):
        """What the walk holds of a branch; ``above``: bytes that it shares with either end of the run."""
        same = [_common(k, branch.key, n, branch.stop) if n == branch.start else n for n, (k, _) in zip(above, edges, strict=True)]
        own = Share() if branch.value is None else Share(counts[branch.value], leasts[branch.value])
        return branch, own, same, branch.layout.children() if branch.layout else iter(())

    # Children before parents, without recursion.
    stack = [opened(tree.root, [0, 0])]
    while stack:
        branch, share, same, kids = stack[-1]
        kid = next(kids, None)
        if kid is not None:
            stack.append(opened(kid, same))
            continue
        stack.pop()
        # The turn-aligned depths that the path passes, the deepest first.
        for at in range(branch.stop - branch.stop % WIDTH, branch.start if stack else -1, -WIDTH):
            share = emit(branch, at, share, next((d[at // WIDTH] for n, (_, d) in zip(same, edges, strict=True) if at <= n), None))
        if stack:
            stack[-1][1].add(share)
    rows.append([None] * 10 + [keys[0], keys[-1], sizes[-1]])
    return rows


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One tree for each batch of sorted keys."""
    for b in batches:
        if b.num_rows:
            columns = [b.column(c).to_pylist() for c in ("key", "n", "least", "sizes", "ends")]
            rows = run_nodes(*columns)
            for lo in range(0, len(rows), 20_000):
                part = zip(*rows[lo : lo + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, COLUMNS.values(), strict=True)], list(COLUMNS))


def corrections(first: bytes, last: bytes, sizes: list[int]) -> list[tuple[bytes, int, int, int]]:
    """(node, children, leaves, saved) to add where a run ends with ``last`` and the next begins with ``first``.

    Both counted the nodes that the two keys share: a node's child that is shared was one
    child, not two; its text is kept once; and ``last`` is no leaf if ``first`` goes on from it.
    """
    turns = min(len(first), len(last)) // WIDTH
    same = next((t for t in range(turns) if first[t * WIDTH : (t + 1) * WIDTH] != last[t * WIDTH : (t + 1) * WIDTH]), turns)
    leaf = -1 if same * WIDTH == len(last) else 0
    out, saved = [], 0
    digests = _prefixes(last[: same * WIDTH])
    for d in range(same, -1, -1):
        saved += sizes[d - 1] if d else 0
        out.append((digests[d], -1 if d < same else 0, leaf, saved))
    return out


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, last, sizes in zip(b.column("next").to_pylist(), b.column("last").to_pylist(), b.column("sizes").to_pylist(), strict=True):
            node, children, leaves, saved = zip(*corrections(first, last, sizes), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), *[pa.array(x, pa.int64()) for x in (children, leaves, saved)]], ["node", "n_children", "n_leaves", "saved_tokens"])


# ---------------------------------------------------------------- equal conversations


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one conversation's copies, joined to rows of bounded length, from rows sorted by (hash, id)."""
    now, ids, chars = None, [], 0

    def row():
        return [now[0], now[1], now[2], ids[0], len(ids), ",".join(map(str, ids))]

    for b in batches:
        out = []
        for h, key, sizes, c in zip(*[b.column(x).to_pylist() for x in ("h", "key", "sizes", "c")], strict=True):
            if now is not None and (h != now[0] or chars > CHUNK_CHARS):
                out.append(row())
                now, ids, chars = None, [], 0
            now = now or (h, key, sizes)
            ids.append(c)
            chars += len(str(c)) + 1
        if out:
            yield _chunk_batch(out)
    if ids:
        yield _chunk_batch([row()])


def _chunk_batch(rows: list[list]) -> pa.RecordBatch:
    types = (pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["h", "key", "sizes", "c", "n", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key from chunks sorted by (hash, first id); chunks are read one after the other and not held."""
    now = state = None

    def row():
        return [*now, state.hexdigest()]

    names, types = ["key", "sizes", "least", "n", "ends"], (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string())

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    before = None
    for b in batches:
        out = []
        for h, key, sizes, c, n, ids in zip(*[b.column(x).to_pylist() for x in ("h", "key", "sizes", "c", "n", "ids")], strict=True):
            if h != before:
                if now is not None:
                    out.append(row())
                now, state, before = [key, sizes, c, 0], hashlib.sha256(), h
            else:
                state.update(b",")
            now[3] += n
            state.update(ids.encode())
        if out:
            yield batch(out)
    if now is not None:
        yield batch([row()])


# ---------------------------------------------------------------- the whole


def rebuilt(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", shared: int = SHARED) -> DataFrame:
    """(c, key, sizes): every conversation begins with turns of the first of its ``shared``, then goes on with its own."""
    said, by = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.coalesce(F.col(f"`{role}`"), F.lit(""))
    # The role's length keeps role and text apart.
    digest = F.unhex(F.left(F.sha2(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said), 256), F.lit(2 * WIDTH)))
    one = F.struct(F.col(f"`{turn}`").alias("turn"), by.alias("role"), digest.alias("id"), F.octet_length(said).cast("long").alias("size"))
    rows = turns.select(F.col(f"`{conv}`").cast("long").alias("c"), one.alias("x")).filter("c is not null")
    held = rows.groupBy("c").agg(F.sort_array(F.collect_list("x")).alias("x"))
    held = held.select("c", F.transform("x", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"))).alias("x"))
    held = materialize(held, "turns")
    first = held.select(F.col("c").alias("base"), F.slice("x", 1, 8).alias("lead"))
    own = held.select("*", (F.col("c") - F.col("c") % shared).alias("base"), (F.crc32(F.col("c").cast("string").cast("binary")) % 9).cast("int").alias("h"))
    both = own.join(first, "base", "left")
    whole = F.concat(F.slice(F.coalesce("lead", F.slice("x", 1, 0)), F.lit(1), F.col("h")), F.slice("x", F.col("h") + 1, F.greatest(F.size("x"), F.lit(1))))
    out = both.select("c", whole.alias("x"))
    # Concatenated in hexadecimal, as array_join takes texts.
    return out.select("c", F.unhex(F.array_join(F.transform("x", lambda x: F.hex(x["id"])), "")).alias("key"), F.transform("x", lambda x: x["size"]).alias("sizes"))


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns stand by number, null first; those of one number by role, then by a hash of role and
    text. A null role or text is empty. Turns without a conversation's id belong to none and are
    left out. Repeated turns are turns of their own. Without conversations there are no nodes, not
    even a root. One conversation is held by one task, as a document is; other columns are not read.
    """
    spark = turns.sparkSession
    convs = rebuilt(turns, conv, turn, role, text).withColumn("h", F.unhex(F.left(F.sha2("key", 256), F.lit(32))))
    # Copies are sorted by id over many tasks; the few rows that their ids make meet by hash.
    chunks = convs.repartitionByRange("h", "c").sortWithinPartitions("h", "c").mapInArrow(_chunks, "h binary, key binary, sizes array<long>, c long, n long, ids string")
    keys = chunks.repartition("h").sortWithinPartitions("h", "c").mapInArrow(_digests, "key binary, sizes array<long>, least long, n long, ends string")
    keys = materialize(keys, "keys")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), keys.count() // RANGE_KEYS)
    rows = keys.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(_runs, _DDL)
    rows = materialize(rows, "nodes")

    # One row per run.
    runs = rows.filter("first is not null").select("first", "last", "sizes", F.lead("first").over(Window.orderBy("first")).alias("next"))
    off = runs.filter("next is not null").mapInArrow(_corrections, "node binary, n_children long, n_leaves long, saved_tokens long")
    shares = rows.filter("node is not null").select("node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    sums = shares.unionByName(off, allowMissingColumns=True).groupBy("node").agg(
        F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")], F.max("ends_sha256").alias("ends_sha256"),
    )
    sums = materialize(sums, "shares")
    above = sums.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    salted = above.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")]
    inner = rows.filter("depth is not null and node is null and parent is null").select(*columns)
    # A node that runs share may have very many children.
    under = rows.filter("node is null and parent is not null").drop("parent_conv_id").withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int"))
    return inner.unionByName(under.join(salted, ["parent", "salt"]).select(*columns)).unionByName(sums.join(above, "parent", "left").select(*columns))


ORACLE = """
WITH t AS MATERIALIZED (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc FROM (SELECT DISTINCT c FROM t)),
cut AS (SELECT c, xor(crc, 4294967295) % 9 AS h FROM h),
whole AS (SELECT cut.c, k, role, text FROM cut JOIN t ON t.c = cut.c - cut.c % 5 AND k <= h UNION ALL SELECT cut.c, k + 1000000000, role, text FROM cut JOIN t ON t.c = cut.c AND k > h),
seq AS (SELECT cut.c, coalesce(list({'r': role, 't': text} ORDER BY k) FILTER (role IS NOT NULL), []) AS s FROM cut LEFT JOIN whole USING (c) GROUP BY 1),
pre AS (SELECT c, d, len(s) AS n, md5(list_slice(s, 1, d)::VARCHAR) AS p, CASE WHEN d > 0 THEN md5(list_slice(s, 1, d - 1)::VARCHAR) END AS up, CASE WHEN d > 0 THEN strlen(s[d].t) ELSE 0 END AS bytes
  FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM seq)),
node AS MATERIALIZED (SELECT p, d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM pre GROUP BY p, d),
kids AS (SELECT up AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
sub AS (SELECT x.p, x.d, y.p AS q, y.d AS e FROM (SELECT DISTINCT p, d, c FROM pre) x JOIN pre y ON x.c = y.c AND y.d >= x.d GROUP BY ALL)
SELECT node.conv_id, node.d AS depth, above.conv_id AS parent_conv_id, node.n_convs, coalesce(any_value(kids.n), 0) AS n_children,
  count(*) FILTER (low.p NOT IN (SELECT p FROM kids)) AS n_leaves, sum((low.n_convs - 1) * low.bytes)::BIGINT AS saved_tokens, node.ends_sha256
FROM node LEFT JOIN node above ON above.p = node.up AND above.d = node.d - 1 LEFT JOIN kids ON kids.p = node.p AND kids.d = node.d JOIN sub ON sub.p = node.p AND sub.d = node.d JOIN node low ON low.p = sub.q AND low.d = sub.e
GROUP BY node.p, node.conv_id, node.d, above.conv_id, node.n_convs, node.ends_sha256"""
