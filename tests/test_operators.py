"""Operators of the reference against brute force, SQL and invariants."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import sequences as sq
from tessella.operators import bins, community, hubs, hypergraph, linking, scaffold, spectral
from tessella.operators.components import connected_components
from tessella.operators.numbering import numbered
from tessella.plans import queries as core
from tessella.plans.materialize import materialize
from tessella.sources import fasta, interchange, paf
from tessella.streaming import alignments as streaming

#: Labels differ between implementations; ``community_invariants`` has what holds of all.
SLOW = {"community_detection"}


@pytest.mark.parametrize("name", [n for n in core.QUERIES if n not in SLOW])
def test_query_equals_its_sql(spark, sf_dir, name):
    got = core.QUERIES[name](spark, sf_dir).toPandas()
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    want = con.sql(core.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, got[columns].itertuples(index=False, name=None))) == sorted(map(str, want[columns].itertuples(index=False, name=None)))


def greedy(edges, contigs):
    root = {c: c for c in contigs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    used, out = set(), set()
    for w, a, b in sorted(((-w, a, b) for a, b, w in edges)):
        x, y = find(a[:-2]), find(b[:-2])
        if a not in used and b not in used and x != y:
            root[y] = x
            used |= {a, b}
            out.add((a, b, -w))
    return out


@pytest.mark.parametrize("local_edges", [0, 100_000])
def test_parallel_cover_equals_the_sequential_one(spark, local_edges):
    rng = np.random.default_rng(7)
    contigs = [f"c_{p}x{k}" for p in range(3) for k in range(7)]
    rows = []
    for p in range(3):
        ends = [f"c_{p}x{k}_{s}" for k in range(7) for s in (1, 2)]
        for i, a in enumerate(ends):
            for b in ends[:i]:
                if a[:-2] != b[:-2] and rng.random() < 0.5:
                    rows.append((p, min(a, b), max(a, b), float(rng.integers(1, 5))))
    edges = spark.createDataFrame(rows, "partition int, a string, b string, w double")
    members = spark.createDataFrame([(int(c[2]), c) for c in contigs], "partition int, contig string")
    got = {(r.a, r.b, r.w) for r in linking.greedy_path_cover(edges, members, local_edges).collect()}
    assert got == greedy([r[1:] for r in rows], contigs)


def test_chains_cover_every_contig_once(spark):
    members = spark.createDataFrame([(0, f"x_{k}", k) for k in range(9)], "partition int, contig string, ord int")
    links = [("x_4_1", "x_2_2", 9.0), ("x_2_1", "x_7_1", 8.0), ("x_5_2", "x_0_1", 3.0)]
    out = linking.chains(spark.createDataFrame([(0, min(a, b), max(a, b), w) for a, b, w in links], "partition int, a string, b string, w double"), members)
    got = {}
    for r in out.orderBy("chain_no", "pos").collect():
        got.setdefault(r.chain_no, []).append((r.endpoint[2:], r.w_next))
    assert [e for e, _ in got[1]] == ["0_2", "0_1", "5_2", "5_1"]
    assert [e for e, _ in got[3]] == ["4_2", "4_1", "2_2", "2_1", "7_1", "7_2"]
    assert [w for _, w in got[3]] == [100000.0, 9.0, 100000.0, 8.0, 100000.0, None]
    assert sorted(len(v) for v in got.values()) == [2, 2, 2, 2, 4, 6]


def turns_in_order(kept, every, seen, least):
    """The pass: ``seen`` lists all pairs in the order in which they were met."""
    want, degree = {e: every[e] for e in seen if e in kept}, {}
    for a, b in want:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    near = {}
    for a, b in seen:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    for v in list(degree):
        pair = lambda n: (min(v, n), max(v, n))
        for n in sorted(near[v], key=lambda n: -every[pair(n)]):
            if pair(n) not in want and degree[v] < least:
                want[pair(n)] = every[pair(n)]
                degree[v] += 1
                degree[n] = degree.get(n, 0) + 1
    return want


def topped_up(spark, kept, every, seen, least):
    frames = [spark.createDataFrame([(a, b, w) for (a, b), w in x.items()], "a int, b int, w double") for x in (kept, every)]
    order = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(seen)], "a int, b int, seen int")
    out = hypergraph.top_up(*frames, least, order)
    return {(r.a, r.b): r.w for r in out.collect()}


@pytest.mark.parametrize("seed", range(6))
def test_top_up_equals_turns_in_order(spark, seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(5, 26))
    every = {(a, b): float(rng.integers(1, 9)) for b in range(n) for a in range(b) if rng.random() < 0.5}
    kept = {e: w for e, w in every.items() if w >= 8}
    seen = [list(every)[k] for k in rng.permutation(len(every))]
    for least in (3, 5):
        assert topped_up(spark, kept, every, seen, least) == turns_in_order(kept, every, seen, least)
    frames = [spark.createDataFrame([(a, b, w) for (a, b), w in x.items()], "a int, b int, w double") for x in (kept, every)]
    assert hypergraph.top_up(*frames).count() == len(kept)


def test_a_row_of_waits_takes_few_rounds(spark, monkeypatch):
    """Vertices in a row, each short of one and with the next as its best offer: every other one adds it."""
    n = 600
    every, kept = {}, {}
    for k in range(n):
        kept[k, 10_000 + k] = every[k, 10_000 + k] = 100.0
        if k:
            every[k - 1, k] = 50.0 + (k % 7 == 3)
        every[k, 20_000 + k] = 1.0
    seen = list(kept) + [e for e in every if e not in kept]
    rounds = rounds_of(monkeypatch, hypergraph)
    assert topped_up(spark, kept, every, seen, 2) == turns_in_order(kept, every, seen, 2)
    assert rounds["left"] <= 4 and rounds["asks"] <= 50


def test_pairs_by_tiles(spark):
    """Every pair once at any size of tile, and no task with most of a large group."""
    from tessella.operators.tiles import pairs_within

    rows = spark.createDataFrame([("large", k, k * k) for k in range(300)] + [(f"s{k // 3}", k, k) for k in range(30)] + [("one", 1, 1), (None, 2, 2)], "g string, x int, y int")
    for tile, sized in ((7, False), (64, True), (10_000, False)):
        given = rows.withColumn("n", F.when(F.col("g") == "large", 300).otherwise(3)) if sized else rows
        got = [tuple(r) for r in pairs_within(given, ["g"], "x", ["y"], "n" if sized else None, tile).collect()]
        want = [("large", a, b, a * a, b * b) for b in range(300) for a in range(b)] + [(f"s{k}", a, b, a, b) for k in range(10) for b in range(3 * k, 3 * k + 3) for a in range(3 * k, b)]
        assert sorted(got) == sorted(want)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        big = spark.range(3000).selectExpr("1 as g", "id as x").repartition(8)
        met = pairs_within(big, ["g"], "x", [], None, 100)
        per = [r.n for r in met.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(per) == 3000 * 2999 // 2 and len(per) == 8 and max(per) < 2 * sum(per) / 8


def test_planted_communities(spark):
    rng = np.random.default_rng(5)
    edges = [(a, b, 5.0 if a // 8 == b // 8 else 0.2) for b in range(32) for a in range(b) if a // 8 == b // 8 or rng.random() < 0.2]
    frame = spark.createDataFrame(edges, "a int, b int, w double")
    vertices = spark.createDataFrame([(v,) for v in range(34)], "vertex int")
    found = community.relabel(community.louvain(frame, vertices))
    groups = {}
    for r in found.collect():
        groups.setdefault(r.label, set()).add(r.vertex)
    assert sorted(map(sorted, groups.values())) == [[*range(0, 8)], [*range(8, 16)], [*range(16, 24)], [*range(24, 32)], [32], [33]]
    alone = vertices.select("vertex", F.col("vertex").alias("label"))
    assert community.modularity(frame, found) > community.modularity(frame, alone)
    assert community.louvain(frame.limit(0), vertices).count() == 34


def planted(spark, n=96, size=24):
    """(edges as rows, their table, vertices): groups of ``size`` that hold together, and some ties between."""
    rng = np.random.default_rng(5)
    edges = [(a, b, 5.0 if a // size == b // size else 0.2) for b in range(n) for a in range(b) if a // size == b // size or rng.random() < 0.2]
    return edges, spark.createDataFrame(edges, "a int, b int, w double"), spark.createDataFrame([(v,) for v in range(n)], "vertex int")


def test_nearest_rows_against_all_pairs(spark):
    """Also of vertices without an edge, which only share their norm of zero, and of a pair by itself."""
    edges, _, _ = planted(spark, 40, 8)
    edges += [(50, 51, 3.0)]
    frame = spark.createDataFrame([*edges, (None, 3, 1.0), (7, 7, 9.0)], "a int, b int, w double")
    names = [*range(44), 50, 51]
    vertices = spark.createDataFrame([(v, "x") for v in [*names, 3, None]], "vertex int, w string")
    got = {(r.v, r["rank"]): r.u for r in spectral.nearest(frame, vertices, 9).collect()}
    m = np.zeros((52, 52))
    for a, b, w in edges:
        m[a, b] = m[b, a] = w
    square = np.float32((m * m).sum(1)).astype(float)
    want = {}
    for v in names:
        others = sorted((np.float32(square[v] + square[u] - 2 * m[v] @ m[u]), square[u], u) for u in names if u != v)
        want |= {(v, k + 1): u for k, (_, _, u) in enumerate(others[:9])}
    assert got == want
    assert spectral.nearest(frame.limit(0), vertices.limit(0), 9).count() == 0


@pytest.mark.parametrize("rows", [100_000, 5])
def test_eigenvectors(spark, monkeypatch, rows):
    """Values as of numpy, vectors orthogonal; with every row a hub too."""
    monkeypatch.setattr(hubs, "HUB_ROWS", rows)
    _, frame, vertices = planted(spark)
    s = materialize(spectral.affinity(spectral.nearest(frame, vertices, 9)), "affinity")
    vectors, values, residual = spectral.eigenvectors(s, 4)
    m = np.zeros((96, 96))
    for r in s.collect():
        m[r.v, r.u] = r.s
    assert np.allclose(m, m.T) and residual <= spectral.RESIDUAL
    assert np.abs(values - np.linalg.eigvalsh(m)[::-1][:4]).max() < 1e-6
    x = np.array([[r[f"x{j}"] for j in range(4)] for r in vectors.orderBy("v").collect()])
    assert np.abs(x.T @ x - np.eye(4)).max() < 1e-9
    assert np.linalg.norm(m @ x - x * values, axis=0).max() <= 1.01 * spectral.RESIDUAL


def test_spectral_finds_planted_groups(spark):
    _, frame, vertices = planted(spark)
    got = {r.vertex: r.label for r in spectral.spectral(frame, vertices, 4, 10).collect()}
    assert got == {v: v // 24 * 24 for v in range(96)}


def test_ways_to_communities(spark):
    frame, vertices = spark.createDataFrame([(4, 9, 1.0)], "a int, b int, w double"), spark.createDataFrame([(9,), (4,)], "vertex int")
    for method in community.METHODS:
        assert len({r.label for r in community.grouped(frame, vertices, method, 1.0, 42).collect()}) == 1
    with pytest.raises(ValueError, match="louvain, spectral"):
        community.grouped(frame, vertices, "other", 1.0, 42)


def test_spectral_of_few_vertices(spark):
    frame, names = spark.createDataFrame([(4, 9, 1.0)], "a int, b int, w double"), [(9,), (4,), (None,), (9,)]
    vertices = spark.createDataFrame(names, "vertex int")
    assert sorted(map(tuple, spectral.spectral(frame, vertices).collect())) == [(4, 4), (9, 4)]
    assert spectral.spectral(frame, vertices.limit(0)).count() == 0
    three = vertices.unionByName(spark.createDataFrame([(5,)], "vertex int"))
    assert {r.vertex for r in spectral.spectral(frame, three).collect()} == {4, 5, 9}


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100), (7, 60), (61, 60), (200, 201), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 60: 0, 61: 0, 100: 100, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_hubs(spark, monkeypatch):
    """Two stars and a path between, with every node of over ten edges a hub, and with none."""
    edges = [(1000 + k, 5) for k in range(300)] + [(3, 5000 + k) for k in range(300)] + [(1000, 900), (900, 901), (901, 5000)] + [(70, 71)]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = {v: 70 if v in (70, 71) else 3 for e in edges for v in e}
    for rows, most in ((10, 1000), (10**6, 10)):
        monkeypatch.setattr(hubs, "HUB_ROWS", rows)
        monkeypatch.setattr(hubs, "HUBS", most)
        assert {r.node: r.component for r in connected_components(frame).collect()} == want


def test_edges_of_a_hub_stay_apart(spark):
    """A star of 40,000 leaves: its rows are joined where they lie, and no task gets more than its share."""
    rows = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") < 39_000, 0).otherwise(F.col("id")).alias("u"), "id")
    rows = materialize(rows, "rows")
    per = materialize(rows.groupBy("u").agg(F.count("*").alias("n")), "per")
    met = hubs.join_split(rows, per, "u", per.filter("n > 1000").select("u"))
    spread = [r.n for r in met.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(spread) == 40_000 and max(spread) < 2 * 40_000 / 8
    assert met.agg(F.sum("n")).first()[0] == 39_000**2 + 1_000


def test_numbered(spark):
    rows = spark.range(1000).withColumn("k", F.xxhash64("id"))
    got = [r.no for r in numbered(rows, [F.asc("k")], "no").orderBy("k").collect()]
    assert got == list(range(1, 1001))


def test_scalar_cases(spark):
    one = spark.createDataFrame([("ACgTNX", "chr21_contig_218", "a_b_1")], "s string, n string, e string")
    r = one.select(sq.reverse_complement(F.col("s")).alias("rc"), sq.digit_segment(F.col("n")).alias("n"), sq.stem(F.col("e")).alias("st"), sq.wrap(F.col("s"), 4).alias("w")).first()
    assert tuple(r) == ("NNANGT", 218, "a_b", "ACgT\nNX")
    gaps = [(200, 0.379, 2.8475, 28), (123, 0.379, 2.8475, 100), (703.8, 0.379, 2.8475, 1), (2000, 0.4431, 4.0218, 42), (20, 0.4431, 4.0218, 100), (0, 0.379, 2.8475, 100)]
    for w, a, b, want in gaps:
        assert one.select(sq.gap_length(F.lit(float(w)), a, b)).first()[0] == want
    assert one.select(F.rint(F.lit(2.5)), F.rint(F.lit(3.5))).first()[:] == (2.0, 4.0)
    with pytest.raises(Exception, match="no number"):
        one.select(sq.digit_segment(F.lit("no_digits"))).collect()


def test_vertex_filter_boundaries(spark):
    rows = [("r", "c_1", 300.9, 0), ("r", "c_2", 150.45, 1), ("s", "c_1", 7.0, 2), ("t", "c_1", 10.0, 3), ("t", "c_2", 4.9, 4), ("t", "c_3", None, 5)]
    frame = spark.createDataFrame(rows, "read string, contig string, weight double, first int")
    got = sorted((r.read, r.contig, r.weight) for r in hypergraph.vertex_filter(frame, -1).collect())
    assert got == [("r", "c_1", 300), ("r", "c_2", 150), ("s", "c_1", 7), ("t", "c_1", 10)]
    both = spark.createDataFrame([("r", "a_5", 1.0, 0), ("r", "b_05", 2.0, 1), ("r", "x", 3.0, 2)], "read string, contig string, weight double, first int")
    assert hypergraph.to_hyperedges(both).count() == 0  # "x" is no number: no line of this read can be read
    assert [(r.vertex, r.weight) for r in hypergraph.to_hyperedges(both.filter("first < 2")).collect()] == [(5, 2.0)]


def test_bins_mirrored_and_short(spark):
    rows = spark.createDataFrame([("r", "c_1", 900, 0, 450), ("r", "c_2", 5000, 4500, 5000)], "read string, contig string, t_len long, t_start long, t_end long")
    plain = {(r.contig, r.side): (r.lo, r.hi) for r in bins.end_bins(rows, [400]).collect()}
    assert plain == {("c_1", 1): (0, 1), ("c_1", 2): (0, 1), ("c_2", 2): (3, 4)}
    flipped = {(r.contig, r.side): (r.lo, r.hi) for r in bins.end_bins(rows, [400], mirrored=True).collect()}
    assert flipped[("c_2", 2)] == (0, 1) and flipped[("c_1", 1)] == (0, 1)


@pytest.mark.parametrize(("ends", "text"), [(["a_1_1"], "odd"), (["a_1_1", "b_2_2"], "two contigs"), (["a_1_1", "a_1_1"], "no pair")])
def test_orientation_errors(spark, ends, text):
    frame = spark.createDataFrame([(1, k, e) for k, e in enumerate(ends)], "chain int, pos int, endpoint string")
    with pytest.raises(Exception, match=text):
        scaffold.oriented(frame).collect()


def test_assembly_misses_a_sequence(spark):
    pieces = spark.createDataFrame([(1, 0, "a_1", True, 0)], "chain int, piece int, contig string, forward boolean, gap int")
    with pytest.raises(Exception, match="no sequence"):
        scaffold.assemble(pieces, spark.createDataFrame([("b", "A")], "name string, seq string")).collect()


def test_fasta_and_interchange(spark, tmp_path):
    (tmp_path / "x.fa").write_text("before\n>a one two\r\nAC \r\ngt\n>b\n>a\nTTT\n")
    rows = fasta.read_fasta(spark, str(tmp_path / "x.fa"))
    assert [(r.name, r.seq, r.length) for r in rows.orderBy("row_id").collect()] == [("a", "AC gt", 5), ("b", "", 0), ("a", "TTT", 3)]
    assert [(r.name, r.length) for r in fasta.last_of_each_name(rows).orderBy("row_id").collect()] == [("a", 3), ("b", 0)]
    assert [(r.name, r.seq) for r in fasta.renamed(rows).orderBy("row_id").collect()] == [("chr1_contig_1", "AC GT"), ("chr1_contig_2", ""), ("chr1_contig_3", "TTT")]
    assert [r.value for r in fasta.length_lines(rows).orderBy("row_id").collect()] == [">a\n5", ">b\n0", ">a\n3"]
    (tmp_path / "m").write_text("r1:\nc_1,0,9,+,1,2,100\nbad,1\nr2:\n\nr3:\nc_2,0,9,-,1,2,7\n")
    assert [(r.read, r.contig, r.length) for r in interchange.read_merged(spark, str(tmp_path / "m")).orderBy("row_id").collect()] == [("r1", "c_1", 100.0), ("r3", "c_2", 7.0)]
    (tmp_path / "t").write_text("r1:\nc:1,9,1,2,60\nc,x,1,2,60\n\nodd name:\nc_3,9,1,2,60\n")
    assert [(r.read, r.contig) for r in interchange.read_extracted(spark, str(tmp_path / "t")).orderBy("row_id").collect()] == [("r1", "c1"), ("r1", "c_3")]
    (tmp_path / "h").write_text("1 2.5 2 3 1 4\n1 2 3\n1 x\n\n7 1\n")
    assert sorted((r.vertex, r.pos, r.weight) for r in interchange.read_hyperedges(spark, str(tmp_path / "h")).collect()) == [(1, 0, 4.0), (2, 1, 3.0), (7, 0, 1.0)]
    (tmp_path / "p").write_text("0: 1 2\nnone\n1: 3\n0: 4\n")
    assert sorted((r.partition, r.vertex) for r in interchange.read_partitions(spark, str(tmp_path / "p")).collect()) == [("0", "1"), ("0", "2"), ("0", "4"), ("1", "3")]
    (tmp_path / "w").write_text("1 2 74.70\n1 3 0.00\n")
    assert [(r.a, r.b, r.weight) for r in interchange.read_weights(spark, str(tmp_path / "w")).collect()] == [(1, 2, 74.7)]
    (tmp_path / "c").write_text("0_1: a_1 a_2\nbroken\n")
    assert [(r.chain, r.pos, r.endpoint) for r in interchange.read_chains(spark, str(tmp_path / "c")).orderBy("pos").collect()] == [("0_1", 0, "a_1"), ("0_1", 1, "a_2")]


def test_rejected_lines_and_reasons(spark, tmp_path):
    from tessella.sources.text import rejected, scan_lines

    good = "r\t1\t0\t9\t+\tc_1\t9\t0\t9\t9\t9\t60"
    (tmp_path / "p").write_text("\n".join([good, "", "short\tline", good.replace("\t60", "\thigh"), good.replace("c_1\t9\t0", "c_1\t9\tx")]) + "\n")
    told = lambda rows: [(r.value, r.reason) for r in rejected(rows).orderBy("row_id").collect()]
    assert [w for _, w in told(paf.scan_alignments(spark, str(tmp_path / "p")))] == ["fields", "fields", "integers", "integers"]
    assert [w for _, w in told(paf.scan_placements(spark, str(tmp_path / "p")))] == ["fields", "integers"]
    assert paf.read_alignments(spark, str(tmp_path / "p")).columns == ["row_id", "read", "q_start", "q_end", "strand", "contig", "t_start", "t_end", "mapq"]
    (tmp_path / "m").write_text("early,1,2\nr1:\nc_1,0,9,+,1,2,100\nbad,1\n")
    assert told(interchange.scan_merged(scan_lines(spark, str(tmp_path / "m")))) == [("early,1,2", "header"), ("bad,1", "fields")]
    (tmp_path / "t").write_text("c,1,2,3,4\nr1:\nc:1,9,1,2,60\nc,x,1,2,60\nc,1,2\n")
    assert told(interchange.scan_extracted(scan_lines(spark, str(tmp_path / "t")))) == [("c,1,2,3,4", "header"), ("c,x,1,2,60", "integers"), ("c,1,2", "fields")]
    (tmp_path / "h").write_text("1 2.5 2 3\n1 2 3\n1 x\n7\n")
    assert told(interchange.scan_hyperedges(scan_lines(spark, str(tmp_path / "h")))) == [("1 2 3", "odd"), ("1 x", "number"), ("7", "odd")]


def test_rounding_of_written_weights(spark):
    rng = np.random.default_rng(8)
    values = [0.125, 1.015, 2.675, 1.115, 74.698484809835, 0.375, 0.005, 0.995, 0.999, 9.995, 0.0, -1.005, 12345678901.125, 2.0**52 + 0.5, 1e15 + 0.3, float("inf"), float("-inf"), float("nan"), 1e19, 1e20, -3e19]
    values += (rng.random(5000) * 10.0 ** rng.integers(0, 9, 5000)).tolist() + (rng.integers(0, 10**7, 5000) / 1000).tolist()
    frame = spark.createDataFrame([(str(k), "x", float(v)) for k, v in enumerate(values)], "a string, b string, weight double")
    got = {r.a: r.value for r in interchange.weight_lines(frame).collect()}
    assert [got[str(k)] for k in range(len(values))] == [f"{k} x {v:.2f}" for k, v in enumerate(values)]


def test_text_of_floats(spark):
    rng = np.random.default_rng(9)
    values = [0.0, -0.0, 1.0, 100000000.0, 1e15, 1e16, 123456789012345680.0, 1e-4, 1.5e-5, 0.1 + 0.2, 2e23, 1.278e22, -3.25e-7, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan")]
    values += (rng.random(3000) * 10.0 ** rng.integers(-8, 25, 3000)).tolist() + (rng.integers(0, 9999, 500) * 1e20).tolist()
    frame = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, x double")
    got = [r.t for r in frame.select("k", sq.float_text(F.col("x")).alias("t")).orderBy("k").collect()]
    # The last of sixteen digits can be the other one that gives the number back.
    assert [g for g, v in zip(got[:17], values) if g != repr(float(v))] == []
    assert all(float(g) == v for g, v in zip(got, values) if v == v)
    assert sum(g == repr(float(v)) for g, v in zip(got, values)) > 0.995 * len(values)


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = "r{0}\t1\t0\t{1}\t+\tc_{2}\t1\t0\t1\t1\t1\t{3}\n"
    for k in range(3):
        (folder / f"{k}.paf").write_text("".join(line.format(i % 3, 10 * i + k, i % 2, 40 + 10 * i) for i in range(5)) + "short\tline\n")
    q = streaming.start(streaming.stream_lengths(spark, str(folder)), "lengths", str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
        got = sorted(map(tuple, spark.table("lengths").collect()))
    finally:
        q.stop()
    rows = paf.read_alignments(spark, str(folder)).filter("mapq >= 60")
    want = rows.groupBy("read", "contig").agg(F.sum(F.col("q_end") - F.col("q_start"))).collect()
    assert got == sorted(map(tuple, want)) and got


@pytest.mark.parametrize("p", [0, 10, 33.3, 50, 97, 100])
def test_quantile_equals_numpy(spark, p):
    from tessella.operators.numbering import exact_quantile

    values = np.random.default_rng(2).normal(size=997).round(2)
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "w double").repartition(7)
    assert exact_quantile(frame, "w", p / 100) == pytest.approx(np.percentile(values, p), abs=1e-12)
    assert exact_quantile(frame.limit(0), "w", 0.5) is None


@pytest.mark.parametrize("p", [0, 3, 50, 99.9, 100])
def test_quantile_cuts_ranges_again(spark, p, monkeypatch):
    from tessella.operators import numbering

    monkeypatch.setattr(numbering, "RANGES", 8)
    monkeypatch.setattr(numbering, "READ", 5)
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=300), np.full(200, 0.25), 10.0 ** rng.integers(-5, 9, 200), [np.inf, np.inf]])
    frame = spark.createDataFrame([(float(v),) for v in values], "w double").repartition(5)
    want = np.nan_to_num(np.percentile(values, p), nan=np.inf, posinf=np.inf)
    assert numbering.exact_quantile(frame, "w", p / 100) == (want if np.isinf(want) else pytest.approx(want, abs=1e-9))


def rounds_of(monkeypatch, module):
    """Counts of ``materialize`` in a module, by name."""
    seen, real = {}, module.materialize

    def counted(df, name="step"):
        seen[name] = seen.get(name, 0) + 1
        return real(df, name)

    monkeypatch.setattr(module, "materialize", counted)
    return seen


@pytest.mark.parametrize("shape", ["contigs", "ends", "both"])
def test_rising_weights_take_few_rounds(spark, shape, monkeypatch):
    """A row of n edges, each of which waits for the next: not a round an edge, but rounds by the logarithm."""
    n = 1000
    if shape == "contigs":  # over both ends of each contig: all are taken
        edges = [(f"c_{k}_2", f"c_{k + 1}_1", float(k)) for k in range(n)]
    elif shape == "ends":  # at one end of each contig: every other edge is taken
        edges = [(f"c_{k}_1", f"c_{k + 1}_1", float(k)) for k in range(n)]
    else:
        edges = [(f"c_{k}_{1 + k % 3 // 2}", f"c_{k + 1}_{1 + (k + 1) % 3 // 2}", float(k)) for k in range(n)]
    edges = [(min(a, b), max(a, b), w) for a, b, w in edges]
    contigs = [f"c_{k}" for k in range(n + 1)]
    members = spark.createDataFrame([(0, c) for c in contigs], "partition int, contig string")
    frame = spark.createDataFrame([(0, *e) for e in edges], "partition int, a string, b string, w double")
    seen = rounds_of(monkeypatch, linking)
    got = {(r.a, r.b, r.w) for r in linking.greedy_path_cover(frame, members, 0).collect()}
    assert got == greedy(edges, contigs)
    assert seen["took"] <= 3 and seen.get("waits", 0) <= 3 * 12


def test_rounds_equal_the_pass_on_many_graphs(spark):
    """Cycles over accepted and later edges, ties, hubs and partitions that share names of contigs."""
    rng = np.random.default_rng(11)
    rows, want = [], set()
    for p in range(40):
        n, levels = int(rng.integers(2, 9)), int(rng.integers(2, 30))
        contigs = [f"c_{k}" for k in range(n)]
        ends = [f"{c}_{s}" for c in contigs for s in (1, 2)]
        mine = [(min(a, b), max(a, b), float(rng.integers(1, levels))) for i, a in enumerate(ends) for b in ends[:i] if a[:-2] != b[:-2] and rng.random() < 0.6]
        rows += [(p, *e) for e in mine]
        want |= {(p, *e) for e in greedy(mine, contigs)}
    edges = spark.createDataFrame(rows, "partition int, a string, b string, w double")
    members = spark.createDataFrame([(p, f"c_{k}") for p in range(40) for k in range(9)], "partition int, contig string")
    assert {tuple(r) for r in linking.greedy_path_cover(edges, members, 0).collect()} == want


def test_seeds_vary_the_sweeps_and_not_the_clear_communities(spark):
    edges = [(a, b, 5.0 if a // 6 == b // 6 else 0.1) for b in range(18) for a in range(b) if a // 6 == b // 6 or (a + b) % 5 == 0]
    frame, vertices = spark.createDataFrame(edges, "a int, b int, w double"), spark.createDataFrame([(v,) for v in range(18)], "vertex int")
    for seed in (1, 42):
        found = {r.vertex: r.label for r in community.louvain(frame, vertices, seed=seed).collect()}
        assert len(set(found.values())) == 3 and all(found[v] == found[v // 6 * 6] for v in range(18))


def test_steps_are_the_sessions_own_and_need_a_shared_folder(spark):
    import os as _os

    from tessella.plans import materialize as m

    other = spark.newSession()
    kept = m.materialize(spark.range(3), "kept")
    with m.steps(other):
        gone = m.materialize(other.range(4), "gone")
        path = gone.inputFiles()[0].removeprefix("file:").replace("///", "/")
        assert gone.count() == 4 and _os.path.exists(path)
    assert not _os.path.exists(path) and kept.count() == 3

    class Far:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Far
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        m.shared_dir(Session)


def rc(seq):
    return "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(c, "N") for c in reversed(seq))


@pytest.mark.parametrize(("size", "stretch", "block"), [(1, 1, 1), (3, 7, 5), (1000, 1 << 20, 80)])
def test_assembly_at_any_size_of_rows(spark, size, stretch, block, monkeypatch):
    from tessella.operators import chunks

    monkeypatch.setattr(chunks, "CHUNK", stretch)
    rng = np.random.default_rng(4)
    seqs = {f"c_{k}": "".join(rng.choice(list("ACGTNacgt"), int(n))) for k, n in enumerate([0, 1, 5, 17, 40, 0])}
    chains = [[(f"c_{int(rng.integers(5))}", bool(rng.integers(2)), int(rng.integers(0, 9)) if p else 0) for p in range(n)] for n in (1, 2, 7, 3)] + [[("c_5", True, 0)]]
    pieces = spark.createDataFrame([(k, p, *x) for k, c in enumerate(chains) for p, x in enumerate(c)], "chain int, piece int, contig string, forward boolean, gap int")
    rows = chunks.chunked(spark.createDataFrame(list(seqs.items()), "name string, seq string"), size)
    got, most = {}, 0
    for r in chunks.assemble(pieces, rows, block).orderBy("chain", "block").collect():
        got[r.chain], most = got.get(r.chain, "") + r.bases, max(most, len(r.bases))
    assert got == {k: "".join("N" * g + (seqs[c] if f else rc(seqs[c])) for c, f, g in chain) for k, chain in enumerate(chains)} and most <= block
    back = {}
    for r in chunks.turned(rows).orderBy("name", "at").collect():
        back[r.name] = back.get(r.name, "") + r.bases
    assert back == {n: rc(x) for n, x in seqs.items()}


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_fasta_lines_with_offsets(spark, tmp_path, split):
    """Records over many input splits, text before the first header, and a second file."""
    lines = ["before", ">a one", *["ACGT" * (k % 5) for k in range(40)], ">b", ">a two", "TT ", "", "G", ">", "x" * 30]
    (tmp_path / "1.fa").write_text("\n".join(lines) + "\n")
    (tmp_path / "2.fa").write_text("lost\n>c\nAC\nGT")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = fasta.read_fasta_chunks(spark, str(tmp_path))
        got = [(r.row_id, r.name, r.header, r.at, r.bases) for r in rows.collect()]
        last = fasta.last_chunks(rows).groupBy("name").agg(F.sum(F.length("bases")).alias("n")).collect()
        known = [(r.name, r.length) for r in fasta.records(rows).orderBy("row_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    seqs = {}
    for rid, name, header, at, bases in sorted(got, key=lambda r: (r[0], r[3])):
        held = seqs.setdefault((rid, name, header), "")
        assert at == len(held)
        seqs[rid, name, header] = held + bases
    assert [(n, h, s) for (_, n, h), s in seqs.items()] == [("a", "a one", "".join(lines[2:42])), ("b", "b", ""), ("a", "a two", "TT G"), ("", "", "x" * 30), ("c", "c", "ACGT")]
    assert known == [("a", 320), ("b", 0), ("a", 4), ("", 30), ("c", 4)] and {(r.name, r.n) for r in last} == {("a", 4), ("b", 0), ("", 30), ("c", 4)}


@pytest.mark.parametrize("most", [1, 1_000_000])
def test_running_sums_in_groups(spark, most, monkeypatch):
    """A large group over many parts, many small ones, and one row alone: as a window and by ranges."""
    from tessella.operators import numbering

    monkeypatch.setattr(numbering, "GROUP_ROWS", most)
    rows = [("big", k, k % 11) for k in range(900)] + [(f"g{k % 50}", k, 2) for k in range(300)] + [("one", 0, 5)]
    frame = spark.createDataFrame(rows, "g string, k int, n int").repartition(5)
    out = numbering.running(frame, ["g"], [F.desc("k")], {"before": F.col("n")}, "rank")
    assert out.columns == ["g", "k", "n", "before", "rank"]
    want, sums, ranks = {}, {}, {}
    for g, k, n in sorted(rows, key=lambda r: -r[1]):
        want[g, k] = (sums.get(g, 0), ranks.get(g, 0) + 1)
        sums[g], ranks[g] = sums.get(g, 0) + n, ranks.get(g, 0) + 1
    assert {(r.g, r.k): (r.before, r.rank) for r in out.collect()} == want


def test_cuts_hubs_and_chains_by_ranges(spark, monkeypatch):
    """The same with groups too large for a task: long chains, a hub's neighbours, many chains in a partition."""
    from tessella.operators import numbering

    rng = np.random.default_rng(6)
    steps = [(c, k, float(rng.choice([1, 3, 9, 40])), bool(rng.random() < 0.2)) for c, n in ((1, 200), (2, 3), (3, 1)) for k in range(n)]
    frame = spark.createDataFrame(steps, "chain int, pos long, w double, internal boolean")
    want, last = {}, {}
    for c, k, w, internal in steps:
        before, piece = last.get(c, (None, 0))
        cut = not internal and bool(before) and w < before * 0.3
        want[c, k] = piece = piece + cut
        last[c] = (None if internal or cut else w, piece)
    star = spark.createDataFrame([(0, k, float(k % 5)) for k in range(1, 60)], "a int, b int, w double")
    members = spark.createDataFrame([(0, f"x_{k}", k) for k in range(40)], "partition int, contig string, ord int")
    links = spark.createDataFrame([(0, "x_3_2", "x_9_1", 5.0)], "partition int, a string, b string, w double")
    seen = []
    for most in (2, 1_000_000):
        monkeypatch.setattr(numbering, "GROUP_ROWS", most)
        assert {(r.chain, r.pos): r.piece for r in linking.split_on_drop(frame).collect()} == want
        ranks = sorted((r.v, r["rank"], r.neighbor) for r in hypergraph.adjacency(star).collect())
        assert [n for v, _, n in ranks if v == 0] == sorted(range(1, 60), key=lambda k: (-(k % 5), k))
        seen.append((ranks, sorted((r.chain_no, r.pos, r.endpoint) for r in linking.chains(links, members).collect())))
    assert seen[0] == seen[1] and max(c for c, _, _ in seen[0][1]) == 39
