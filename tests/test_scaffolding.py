"""The worked micro example of FIXTURES.md, end to end."""

import pytest

from tessella.plans import pipeline as pl

PAF = """\
r1 5000 0 300 + chr1_contig_1 3000 2600 2900 290 300 60
r1 5000 300 350 - chr1_contig_2 3000 0 50 50 50 60
r1 5000 350 450 - chr1_contig_2 3000 50 150 100 100 60
r1 5000 450 520 + chr1_contig_3 3000 100 170 70 70 60
r1 5000 600 900 + chr1_contig_3 3000 300 600 300 300 10
r2 2000 0 90 + chr1_contig_1 3000 2000 2090 90 90 60
r3 2000 0 500 + chr1_contig_1 3000 0 500 500 500
r4 2000 0 200 + chr1_contig_1 3000 2800 3000 200 200 60
r4 2000 200 400 + chr1_contig_2 3000 0 200 200 200 60
""".replace(" ", "\t")


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    d = tmp_path_factory.mktemp("micro")
    (d / "in.paf").write_text(PAF)
    (d / "in.fa").write_text("junk\n>chr1_contig_1 first\r\n" + "A" * 100 + "\r\nCG\r\n>chr1_contig_2\nacGT\n>chr1_contig_3\nTTTT\n")
    return str(d / "in.paf"), str(d / "in.fa")


@pytest.fixture(scope="module")
def stages(spark, inputs):
    return pl.run(spark, *inputs, pl.Parameters(min_w=8))


def test_scans_and_merge(stages):
    rows = sorted((r.read, r.contig, r.q_start, r.q_end, r.strand, r.t_start, r.t_end, r.length) for r in stages.merged.collect())
    assert rows == [
        ("r1", "chr1_contig_1", 0, 300, "+", 2600, 2900, 300),
        ("r1", "chr1_contig_2", 300, 350, "-", 0, 50, 150),
        ("r4", "chr1_contig_1", 0, 200, "+", 2800, 3000, 200),
        ("r4", "chr1_contig_2", 200, 400, "+", 0, 200, 200),
    ]
    kept = [(r.read, r.contig, r.t_start) for r in stages.extracted.orderBy("row_id").collect()]
    assert kept == [
        ("r1", "chr1_contig_1", "2600"), ("r1", "chr1_contig_2", "0"), ("r1", "chr1_contig_2", "50"), ("r1", "chr1_contig_3", "100"),
        ("r4", "chr1_contig_1", "2800"), ("r4", "chr1_contig_2", "0"),
    ]
    contigs = [(r.name, r.length) for r in stages.contigs.orderBy("row_id").collect()]
    assert contigs == [("chr1_contig_1", 102), ("chr1_contig_2", 4), ("chr1_contig_3", 4)]


def test_graph_and_communities(stages):
    edge = stages.graph.collect()
    assert [(e.a, e.b) for e in edge] == [(1, 2)] and edge[0].w == pytest.approx(412.13203435596427, abs=1e-9)
    assert sorted((r.label, r.vertex) for r in stages.communities.collect()) == [(0, 1), (0, 2)]


def test_pair_weights(stages):
    got = {(r.ep_a[-3:], r.ep_b[-3:]): (r.sim, r.cov) for r in stages.pairs.collect()}
    want = {
        ("1_1", "1_2"): (10.0, 10.0), ("1_1", "2_1"): (6.0, 12.071067811865476), ("1_1", "2_2"): (6.0, 12.071067811865476),
        ("1_2", "2_1"): (6.0, 14.485281374238571), ("1_2", "2_2"): (6.0, 12.071067811865476), ("2_1", "2_2"): (10.0, 15.0),
    }
    assert set(got) == set(want)
    for k, (s, c) in want.items():
        assert got[k] == (pytest.approx(s), pytest.approx(c))
    w = stages.contig_weights.collect()
    assert [(r.a, r.b) for r in w] == [("1", "2")] and w[0].weight == pytest.approx(74.698484809835)


@pytest.mark.parametrize(
    ("floor", "want"),
    [(20, [["1_1", "1_2"], ["2_1", "2_2"]]), (8, [["1_1", "1_2", "2_1", "2_2"]]), (6, [["1_2", "1_1", "2_1", "2_2"]])],
)
def test_chains_by_floor(spark, inputs, floor, want):
    got = {}
    for r in pl.run(spark, *inputs, pl.Parameters(min_w=floor)).chains.orderBy("chain_no", "pos").collect():
        got.setdefault(r.chain_no, []).append(r.endpoint.removeprefix("chr1_contig_"))
    assert [got[k] for k in sorted(got)] == want


def test_scaffold_text(spark, stages, tmp_path):
    pl.write(stages, str(tmp_path / "out"))
    text = {d.name: "".join(f.read_text() for f in sorted(d.glob("part-*"))) for d in (tmp_path / "out").iterdir()}
    assert text["merged"].startswith("r1:\nchr1_contig_1,0,300,+,2600,2900,300\nchr1_contig_2,300,350,-,0,50,150\nr2:\nr4:\n")
    assert text["hyperedges"] == "1 300 2 150\n1 200 2 200\n"
    assert text["communities"] == "0: 1 2\n"
    assert text["chains"] == "0_1: chr1_contig_1_1 chr1_contig_1_2 chr1_contig_2_1 chr1_contig_2_2\n"
    assert text["weights"] == "1 2 74.70\n"
    # Weight 74.70 asks for far more than the largest gap.
    seq = "A" * 100 + "CG" + "N" * 100 + "acGT"
    assert text["scaffolds"] == ">scaffold1\n" + "\n".join(seq[i : i + 80] for i in range(0, len(seq), 80)) + "\n"


def test_command_line(spark, inputs, tmp_path, capsys):
    import json

    from tessella.__main__ import main

    paf, contigs = inputs
    main(["--paf", paf, "--contig", contigs, "--output_dir", str(tmp_path / "out"), "--min_w", "20", "-q", "60"])
    said = json.loads(next(x for x in capsys.readouterr().out.splitlines() if x.startswith("{")))
    assert said["alignments"] == {"lines": 9, "rows": 8, "fields": 1, "integers": 0} and said["reads"]["rows"] == 3 and said["merged"] == {"rows": 4, "reads": 2, "length": 850}
    assert said["contigs"] == {"rows": 3, "total": 110, "shortest": 4, "longest": 102, "shared_numbers": 0} and said["scaffolds"]["bases"] == 106 and said["chains"]["chains"] == 2
    text = "".join(f.read_text() for f in sorted((tmp_path / "out" / "chains").glob("part-*")))
    assert text == "0_1: chr1_contig_1_1 chr1_contig_1_2\n0_2: chr1_contig_2_1 chr1_contig_2_2\n"


def test_stages_one_by_one(spark, inputs, tmp_path, capsys):
    import json

    from tessella.__main__ import main

    paf, contigs = inputs
    t = lambda n: str(tmp_path / n)
    main(["merge", paf, t("merged"), "--min_quality", "60"])
    main(["extract", paf, t("extracted")])
    main(["lengths", contigs, t("lengths")])
    main(["hyperedges", t("merged"), t("hyperedges")])
    main(["communities", "-i", t("hyperedges"), "-o", t("graph"), "-c", t("communities"), "--random_seed", "7"])
    main(["link", t("lengths"), t("communities"), t("extracted"), t("chains"), t("weights"), "--min_edge_weight", "8"])
    main(["assemble", contigs, t("chains"), t("weights"), t("scaffolds")])
    main(["rename", contigs, t("renamed")])
    main(["communities", "-i", t("hyperedges"), "-c", t("spectral"), "--method", "spectral"])
    said = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert said[0] == {"alignments": 8, "rejected": {"fields": 1, "integers": 0}, "good": 7, "merged": 4, "length": 850} and said[1]["kept"] == 6 and said[1]["kept_reads"] == 2
    assert said[2]["total"] == 110 and said[3]["hyperedges"] == 2 and said[4]["n"] == 1 and said[5]["chains"] == 1 and said[6] == {"scaffolds": 1, "bases": 206} and said[7] == {"contigs": 3}
    text = {n: "".join(f.read_text() for f in sorted((tmp_path / n).glob("part-*"))) for n in ("hyperedges", "communities", "chains", "weights", "scaffolds", "graph", "renamed", "spectral")}
    assert text["spectral"] == "0: 1 2\n" and text["hyperedges"] == "1 300 2 150\n1 200 2 200\n" and text["communities"] == "0: 1 2\n" and text["weights"] == "1 2 74.70\n"
    assert text["chains"] == "0_1: chr1_contig_1_1 chr1_contig_1_2 chr1_contig_2_1 chr1_contig_2_2\n"
    assert text["graph"].startswith("1 2 412.1320343559642") and text["renamed"].startswith(">chr1_contig_1\nAAAA")
    assert text["scaffolds"].startswith(">scaffold1\n" + "A" * 80)
