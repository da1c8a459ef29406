"""How the work of queries grows: what is shuffled, and the ways for large groups."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessella.functions import sequences
from tessella.operators import community, hubs, hypergraph, numbering, scaffold, spectral
from tessella.operators import alignments as al
from tessella.plans import queries as q
from tessella.sources import fasta, paf
from tessella.sources.text import scan_lines, under_headers
from pyspark.sql import functions as F


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hyperedges_take_one_shuffle(spark, sf_dir):
    for df in (q.kept_entries(spark, sf_dir), q.QUERIES["vertex_filter_factor"](spark, sf_dir), q.QUERIES["hyperedge_weight_geometric"](spark, sf_dir)):
        assert _plan(df).count("Exchange hashpartitioning") == 1


def test_pairs_are_shuffled_once(spark, sf_dir):
    assert _plan(hypergraph.project(q.hyper_lists(spark, sf_dir))).count("Exchange hashpartitioning") == 1


def test_hubs_and_tiles_change_nothing(spark, sf_dir, monkeypatch):
    names = ("clique_projection", "vertex_filter_factor", "min_degree_topup", "hyperedges_of_numbers")
    before = [sorted(q.QUERIES[n](spark, sf_dir).collect()) for n in names]
    monkeypatch.setattr(hubs, "HUB_ROWS", 4)
    monkeypatch.setattr(hubs, "HUBS", 10**9)
    monkeypatch.setattr(hypergraph, "TILE", 2)
    rows = al.quality_filter(q.alignments(spark, sf_dir), 30)
    assert 0 < hubs.hub_keys(rows, "read").count() < rows.select("read").distinct().count()
    assert [sorted(q.QUERIES[n](spark, sf_dir).collect()) for n in names] == before


def test_hubs_with_null_keys(spark, monkeypatch):
    monkeypatch.setattr(hubs, "HUB_ROWS", 2)
    rows = spark.createDataFrame([(None, 1), (None, 2), (None, 3), (1, 4), (1, 5), (2, 6)], "k int, x int")
    assert [r.k for r in hubs.hub_keys(rows, "k").collect()] == [None]
    got = hubs.gathered(rows, "k", lambda part, together: part.withColumn("t", F.lit(together)))
    assert sorted((r.x, r.t) for r in got.collect()) == [(1, False), (2, False), (3, False), (4, True), (5, True), (6, True)]


def test_float_text_works_every_text_out_once(spark):
    # Each mention of the text that is not bound is worked out anew, row by row.
    assert sequences.float_text(F.col("x"))._jc.toString().count("format_string") < 12
    xs = [0.0, -0.0, 0.1, -0.1, 1.5, 0.0001, 0.00012, 1e-5, 1e10, 99999999999.9999, 1e11, 123456.7891, -3.25, 1e16, 1e22, 2e-3, 1 / 3, 2.0**53, 5e-324, 1e15, 0.3, 4.35, 1005.0001]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", sequences.float_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in got if abs(r.x) > 1e-307 or r.x == 0] == [repr(r.x) for r in got if abs(r.x) > 1e-307 or r.x == 0]


def test_dots_as_matrices_and_as_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    m = np.triu(rng.integers(1, 9, (40, 40)) * (rng.random((40, 40)) < 0.3), 1)
    m = m + m.T
    want = {(i, j): float(x) for (i, j), x in np.ndenumerate(m @ m.T) if i < j and x}
    arcs = spark.createDataFrame([(i, j, float(x)) for (i, j), x in np.ndenumerate(m) if x], "i long, u long, w double")
    for dense in (10**9, 0):
        monkeypatch.setattr(spectral, "DENSE", dense)
        assert {(r.i, r.j): r.dot for r in spectral._dots(arcs).collect()} == want
    # Several tiles.
    far = arcs.selectExpr("i * 100 AS i", "u * 100 AS u", "w")
    assert {(r.i // 100, r.j // 100): r.dot for r in spectral._dots(far).collect()} == want


def test_blocks_under_headers_are_not_shuffled(spark, sf_dir, tmp_path):
    (tmp_path / "a.txt").write_text("x,1\nr1:\na,1\n\nb,2\nr2:\nr3:\n" + "c,3\n" * 50 + "r4:\nd,4\n")
    (tmp_path / "b.txt").write_text("e,5\nr5:\nf,6\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("16", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            out = under_headers(scan_lines(spark, str(tmp_path)).filter("value <> ''"), F.col("value").endswith(":"))
            got = sorted((r.value, r.header) for r in out.collect())
            assert _plan(out).split("mapInArrow")[0].count("Exchange hashpartitioning") <= 2
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert got == sorted([("a,1", "r1:"), ("b,2", "r1:"), *[("c,3", "r3:")] * 50, ("d,4", "r4:"), ("e,5", "r4:"), ("f,6", "r5:")])
        assert "Sort [file" not in _plan(out)


def test_merged_blocks_take_one_shuffle(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(q, "materialize", lambda df, name: df)
    assert _plan(q.merged_text(spark, sf_dir)).count("Exchange hashpartitioning") == 1


def test_lengths_without_text(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one\nACGT\nAC\n>y\n\n>z\n" + "ACGTA\n" * 30)
    plain, short = (fasta.read_fasta_chunks(spark, str(tmp_path), bases=b) for b in (True, False))
    assert "bases" not in short.columns
    assert sorted(fasta.records(plain).collect()) == sorted(fasta.records(short).collect())
    assert sorted((r.name, r.length) for r in fasta.records(short).collect()) == [("x", 6), ("y", 0), ("z", 150)]


def test_chains_are_laid_out_with_few_shuffles(spark, sf_dir, monkeypatch):
    for module in (scaffold, numbering):
        monkeypatch.setattr(module, "materialize", lambda df, name: df)
    # Two for the weights' pairs, which are one when run, one each for weights, line items, lookups and chains, and one for lengths of contigs.
    assert _plan(q.scaffold_assembly(spark, sf_dir)).count("Exchange hashpartitioning") == 7


def test_long_chains_change_nothing(spark, sf_dir, monkeypatch):
    want = sorted(duckdb.sql(q.ORACLES["scaffold_assembly"].replace("lineitem", f"'{sf_dir}/lineitem.parquet'").replace("JOIN supplier", f"JOIN '{sf_dir}/supplier.parquet'")).fetchall())
    monkeypatch.setattr(hubs, "HUB_ROWS", 4)
    monkeypatch.setattr(hubs, "HUBS", 10**9)
    monkeypatch.setattr(numbering, "GROUP_ROWS", 3)
    assert sorted(map(tuple, q.scaffold_assembly(spark, sf_dir).collect())) == want


def test_first_pieces_are_dealt_out(spark, monkeypatch):
    rows = [(k, p, f"c_{k % 3 + p}") for k in range(60) for p in range(2 if k % 20 == 0 else 1)] + [(60, 2, "c_1")]
    pieces = scaffold.in_order(spark.createDataFrame([(k, 2 * p + s - 1, f"{c}_{s}") for k, p, c in rows for s in (1, 2)], "chain long, pos long, endpoint string"))
    # Numbers of chains and of contigs overlap, a contig has a weight with itself, and piece 2 of chain 60 has none before it.
    weights = spark.createDataFrame([(a, b, float(a + b)) for a in range(4) for b in range(4)] + [(1, 0, 9.0), (1, 2, -4.0)], "a long, b long, weight double")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        held = scaffold.pair_lookup(pieces, weights)
        got = held.select("*", F.spark_partition_id().alias("part")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.chain, r.w_before) for r in got if not r["first"]} == {(0, 9.0), (20, 5.0), (40, 3.0)}
    first = [r for r in got if r["first"]]
    assert len(first) == 61 and all(r.w_before is None for r in first) and len({r.part for r in first}) > 4


@pytest.mark.parametrize("most", [2, 1_000_000])
def test_pieces_in_order_with_hubs(spark, monkeypatch, most):
    monkeypatch.setattr(hubs, "HUB_ROWS", most)
    monkeypatch.setattr(hubs, "HUBS", 10**9)
    ends = [(1, 0, "a_7_2"), (1, 1, "a_7_1"), (1, 2, "b_5_x_1"), (1, 3, "b_5_x_2"), (1, 6, "a_2_1"), (1, 7, "a_2_2"), (2, 0, "a_7_1"), (2, 1, "a_7_2")]
    schema = "chain int, pos int, endpoint string"
    got = scaffold.in_order(spark.createDataFrame(ends, schema)).select("chain", "piece", "contig", "forward", "number", "before").collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == [(1, 0, "a_7", False, 7, None), (1, 1, "b_5_x", True, 5, 7), (1, 3, "a_2", True, 2, None), (2, 0, "a_7", True, 7, None)]
    for bad, text in (([0], "odd"), ([0, 1, 1], "odd"), ([1, 2, 3], "odd"), ([0, 1, 2], "odd"), ([1], "odd")):
        with pytest.raises(Exception, match=text):
            scaffold.in_order(spark.createDataFrame([(1, k, f"a_1_{k % 2 + 1}") for k in bad], schema)).collect()
    for bad, text in (("b_1_2", "two contigs"), ("a_1_1", "no pair")):
        with pytest.raises(Exception, match=text):
            scaffold.in_order(spark.createDataFrame([(1, 0, "a_1_1"), (1, 1, bad)], schema)).collect()


@pytest.mark.parametrize("settle", [2048, 100])
def test_chains_of_moves_take_few_turns(spark, monkeypatch, settle):
    monkeypatch.setattr(community, "SETTLE", settle, raising=False)
    rng = np.random.default_rng(3)
    edges = [(a, b, float(rng.integers(1, 9))) for b in range(300) for a in range(b) if rng.random() < 0.06]
    frame, vertices = spark.createDataFrame(edges, "a int, b int, w double"), spark.createDataFrame([(v,) for v in range(301)], "vertex int")
    turns, judged = [], community._judged
    monkeypatch.setattr(community, "_judged", lambda *x: turns.append(1) or judged(*x))
    found = {r.vertex: r.label for r in community.louvain(frame, vertices).collect()}
    assert len(turns) < 24 and sorted(found) == [*range(301)]
    # No community gains by joining another, and modularity is what a graph without any structure has at the least.
    m, at = np.zeros((301, 301)), np.array([found[v] for v in range(301)])
    for a, b, w in edges:
        m[a, b] = m[b, a] = w
    quality = (m * (at[:, None] == at) - np.outer(m.sum(0), m.sum(0)) * (at[:, None] == at) / m.sum()).sum() / m.sum()
    assert abs(quality - community.modularity(frame, spark.createDataFrame([*found.items()], "vertex int, label int"))) < 1e-9
    assert quality > 0.17
    for c in set(at):
        for d in set(at):
            assert c == d or m[at == c][:, at == d].sum() <= m[at == c].sum() * m[at == d].sum() / m.sum() + 1e-6 * m.sum()


def test_no_single_move_is_left(spark):
    rng = np.random.default_rng(8)
    m = np.triu(rng.integers(1, 9, (60, 60)) * (rng.random((60, 60)) < 0.2), 1).astype(float)
    m, alone = m + m.T, np.arange(60)
    k = m.sum(0)
    rows = [(0, v, v, k[v], v) for v in alone] + [(2, None, v, k[v], 0) for v in alone]
    rows += [(n, i, j, m[i, j], 0) for n in (1, 3) for i, j in np.argwhere(m)]
    moved = community._settling(pd.DataFrame(rows, columns=["kind", "i", "j", "x", "line"]), k.sum(), 1.0)
    at = alone.copy()
    at[moved["v"].astype(int)] = moved["c"]
    for v in alone:
        into = np.array([m[v, at == c].sum() for c in alone])
        gain = np.where(into > 0, into - k[v] * np.array([k[(at == c) & (alone != v)].sum() for c in alone]) / k.sum(), -np.inf)
        stay = into[at[v]] - k[v] * k[(at == at[v]) & (alone != v)].sum() / k.sum()
        assert gain.max() <= stay + 1e-6


@pytest.mark.parametrize("full", [0, 1 / 300, 10])
def test_products_of_blocks(monkeypatch, full):
    monkeypatch.setattr(spectral, "FULL", full, raising=False)
    rng = np.random.default_rng(4)
    m = rng.integers(1, 5, (30, 3000)) * (rng.random((30, 3000)) < 0.1)
    m[:, 1024:2048] = 0
    sides = []
    for at in (slice(0, 12), slice(12, 30)):
        part = m[at].astype(float)
        i, k = np.divmod(np.arange(len(part) * 3), 3)
        cells = [np.flatnonzero(part[a, b * 1024 : b * 1024 + 1024]) for a, b in zip(i, k)]
        rows = pd.DataFrame({"i": 100 - i, "k": k, "sq": (part[i] ** 2).sum(1), "us": cells, "ws": [part[a, b * 1024 + c] for a, b, c in zip(i, k, cells)]})
        sides.append((part, spectral._laid(rows[rows["us"].map(len) > 0])))
    for a, first in sides:
        assert (np.diff(first[1]) >= 0).all()
        for b, second in sides:
            assert (spectral._multiplied(first, second) == a[100 - first[0]] @ b[100 - second[0]].T).all()


def test_nearest_by_blocks_of_rows(spark, monkeypatch):
    """All pairs have a common neighbour, but what is written are the nearest of each row and block; many rows are equal."""
    for name, value in {"DENSE": 0, "LEAST_ROWS": 8, "MOST_ROWS": 8, "ARCS": 100}.items():
        monkeypatch.setattr(spectral, name, value, raising=False)
    rng = np.random.default_rng(2)
    m = np.triu(rng.integers(1, 3, (48, 48)) * (rng.random((48, 48)) < 0.4), 1).astype(float)
    m[40:, :] = m[:, 40:] = 0
    m[:4, 40:44] = 1
    m = m + m.T
    edges = [(int(a), int(b), float(m[a, b])) for a, b in np.argwhere(np.triu(m))]
    written, step = [], spectral.materialize
    monkeypatch.setattr(spectral, "materialize", lambda df, name="step": written.append(name) or step(df, name))
    got = spectral.nearest(spark.createDataFrame(edges, "a int, b int, w double"), spark.createDataFrame([(v,) for v in range(48)], "vertex int"), 5)
    square = np.float32((m * m).sum(1)).astype(float)
    want = set()
    for v in range(48):
        others = sorted((np.float32(square[v] + square[u] - 2 * m[v] @ m[u]), square[u], u) for u in range(48) if u != v)
        want |= {(v, u, k + 1) for k, (_, _, u) in enumerate(others[:5])}
    assert {tuple(r) for r in got.collect()} == want
    assert "dots" not in written


@pytest.mark.parametrize("kept, most", [(24, 50), (6, 60)])
def test_close_eigenvalues_take_few_multiplications(spark, monkeypatch, kept, most):
    """The values of a random graph lie close together but for the first; with few blocks the leading vectors go on alone."""
    monkeypatch.setattr(spectral, "KEPT", kept, raising=False)
    rng = np.random.default_rng(6)
    m = np.triu(rng.random((300, 300)) < 0.08, 1).astype(float)
    m = m + m.T
    m /= np.sqrt(np.outer(m.sum(0), m.sum(0)))
    s = spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in np.argwhere(m)], "v int, u int, s double")
    joins, join = [], type(s).join
    monkeypatch.setattr(type(s), "join", lambda *x: joins.append(1) or join(*x))
    vectors, values, residual = spectral.eigenvectors(s, 6)
    x = np.array([[r[f"x{j}"] for j in range(6)] for r in vectors.orderBy("v").collect()])
    assert np.abs(values - np.linalg.eigvalsh(m)[::-1][:6]).max() < 1e-6
    assert np.abs(x.T @ x - np.eye(6)).max() < 1e-9
    assert np.linalg.norm(m @ x - x * values, axis=0).max() <= 1.01 * spectral.RESIDUAL
    # Two for a multiplication.
    assert len(joins) < most


def test_lines_are_split_once(spark, tmp_path):
    line = "r1\t9\t0\t100\t+\tc_1\t5\t0\t9\t1\t2\t60"
    (tmp_path / "a.paf").write_text(f" \x0b{line} \x0c\r\n\n{line}\tx\n{line[:-3]}\n{line}x\n")
    for rows, want in ((paf.read_alignments(spark, str(tmp_path)).filter("mapq >= 30"), 2), (paf.read_placements(spark, str(tmp_path)).filter("mapq >= 30"), 2)):
        assert _plan(rows).count("split(") == 1
        assert [r.read for r in rows.collect()] == ["r1"] * want
