"""The whole way from alignments and contigs to scaffolds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessella.operators import alignments as al
from tessella.operators import bins, chunks, community, hypergraph, linking, scaffold
from tessella.functions.sequences import two_decimals
from tessella.operators.numbering import numbered
from tessella.plans.materialize import materialize
from tessella.sources import fasta, interchange, paf
from tessella.sources.text import ROW_ID, kept, reasons, write_lines


@dataclass(frozen=True)
class Parameters:
    """min_w is the floor of both linking stages; drop_w is accepted but cuts nothing in chains of two-ended contigs."""

    min_quality: int = 60
    min_w: float = 20
    drop_w: float = 0.3
    resolution: float = 1.0
    random_seed: int = 42
    alpha: float = scaffold.ALPHA
    beta: float = scaffold.BETA
    max_gap: float = scaffold.MAX_GAP
    min_gap: float = scaffold.MIN_GAP
    vertex_factor: float = 1.0
    weight_strategy: int = hypergraph.GEOMETRIC
    weight_power: float = 1.0
    percentile: float = 10
    min_degree: int = 1
    method: str = "louvain"


@dataclass(frozen=True)
class Stages:
    """Every stage's rows, for looking at and for writing as text."""

    reads: DataFrame
    merged: DataFrame
    extracted: DataFrame
    contigs: DataFrame
    entries: DataFrame
    hyperedges: DataFrame
    graph: DataFrame
    communities: DataFrame
    members: DataFrame
    pairs: DataFrame
    links: DataFrame
    chains: DataFrame
    contig_weights: DataFrame
    scaffolds: DataFrame
    seen: dict[str, Observation]


def _counted(scan: DataFrame, seen: Observation) -> DataFrame:
    """``scan`` with its lines, good rows and rejected lines counted as it is written."""
    return scan.observe(seen, F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("reason").isNull(), 1)).alias("rows"), *[c.alias(k) for k, c in reasons(*paf.REASONS).items()])


def report(stages: Stages) -> dict:
    """Counts of a whole run, stage by stage: what was read, rejected and made."""

    def one(df: DataFrame, **figures) -> dict:
        return df.agg(F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in figures.items()]).first().asDict()

    def distinct(*columns: str):
        return F.countDistinct(*columns)

    out = {name: dict(x.get) for name, x in stages.seen.items()}
    out["reads"] = one(stages.reads)
    out["merged"] = one(stages.merged, reads=distinct("read"), length=F.coalesce(F.sum("length"), F.lit(0)))
    out["extracted"] = one(stages.extracted, reads=distinct("read"))
    out["contigs"] = one(stages.contigs, total=F.coalesce(F.sum("length"), F.lit(0)), shortest=F.min("length"), longest=F.max("length"))
    out["contigs"]["shared_numbers"] = bins.duplicate_suffixes(stages.contigs.select(F.col("name").alias("contig")).distinct()).count()
    out["hyperedges"] = one(stages.hyperedges, hyperedges=distinct("edge_id"), vertices=distinct("vertex"))
    out["hyperedges"]["unnumbered"] = hypergraph.labelled(stages.entries).filter(F.col("vertex").try_cast("long").isNull()).select("read").distinct().count()
    out["graph"] = one(stages.graph)
    out["communities"] = community.stats(stages.communities).first().asDict()
    out["members"], out["pairs"], out["links"] = one(stages.members), one(stages.pairs), one(stages.links)
    out["chains"] = one(stages.chains, chains=distinct("partition", "chain_no"))
    out["scaffolds"] = one(stages.scaffolds, scaffolds=distinct("no"), bases=F.coalesce(F.sum(F.length("bases").cast("long")), F.lit(0)))
    return out


def contact_graph(merged: DataFrame, p: Parameters = Parameters()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(kept entries, hyperedge vertices, edges, all vertices in order of first sight) from merged alignments.

    ``merged`` has the order of its reads as ``seen``.
    """
    entries = merged.select("read", "contig", F.col("length").alias("weight"), "first", "seen")
    kept = materialize(hypergraph.vertex_filter(entries, p.vertex_factor), "kept")
    vertices = materialize(hypergraph.to_hyperedges(kept), "vertices")
    held = materialize(hypergraph.lists(vertices, p.weight_strategy, p.weight_power), "lists")
    every = materialize(hypergraph.project(held, seen=True), "pairs")
    edges = hypergraph.top_up(hypergraph.percentile_filter(every, p.percentile), every, p.min_degree)
    return kept, vertices, materialize(edges, "edges"), hypergraph.first_sight(vertices)


def run(spark: SparkSession, paf_path: str, fasta_path: str, p: Parameters = Parameters()) -> Stages:
    """All stages; each is written to the shared folder once where several others read it."""
    seen = {name: Observation(name) for name in ("alignments", "placements")}
    scanned = materialize(_counted(paf.scan_alignments(spark, paf_path), seen["alignments"]), "alignments")
    good = materialize(al.quality_filter(kept(scanned), p.min_quality), "good")
    reads = materialize(al.reads_in_order(good), "reads")
    merged = materialize(al.merge(good).join(reads, "read"), "merged")
    placements = materialize(_counted(paf.scan_placements(spark, paf_path), seen["placements"]), "placements")
    extracted = materialize(al.extract(kept(placements), p.min_quality), "extracted")
    bases = materialize(fasta.read_fasta_chunks(spark, fasta_path), "bases")
    contigs = materialize(fasta.records(bases), "contigs")
    entries, vertices, edges, every = contact_graph(merged, p)
    every = materialize(every, "seen")
    communities = materialize(community.relabel(community.grouped(edges, every, p.method, p.resolution, p.random_seed), every), "communities")

    names = contigs.groupBy(F.col("name").alias("contig")).agg(F.min(ROW_ID).alias("ord"))
    parts = communities.select(F.col("label").alias("partition"), F.col("vertex").alias("number"))
    members = materialize(bins.assign_partitions(names, parts).withColumn("ord", F.col("number").cast("long")), "members")
    places = extracted.select("read", F.replace("contig", F.lit(":"), F.lit("")).alias("contig"), *[F.trim(c).try_cast("long").alias(c) for c in ("t_len", "t_start", "t_end")])
    places = bins.of_members(places.dropna(subset=["t_len", "t_start", "t_end"]), members)
    pairs = materialize(bins.pair_weights(bins.coverage(bins.end_bins(places))), "ends")
    sim, cov = (linking.candidate_edges(pairs.withColumn("w", F.col(c)), members, p.min_w) for c in ("sim", "cov"))
    held = members.select("partition", "contig")
    links = materialize(linking.two_phase(linking.greedy_path_cover(sim, held), linking.greedy_path_cover(cov, held), held), "links")
    chains = materialize(linking.chains(links, members), "chains")

    weights = materialize(bins.contig_weights(pairs, members.select("contig", "number")), "weights")
    order = numbered(chains.select("partition", "chain_no").distinct(), [F.asc("partition"), F.asc("chain_no")], "no")
    ends = materialize(chains.join(order, ["partition", "chain_no"]).select(F.col("no").alias("chain"), "pos", "endpoint"), "chain_ends")
    rounded = weights.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), two_decimals(F.col("weight")).cast("double").alias("weight"))
    pieces = scaffold.gaps(scaffold.pair_lookup(scaffold.in_order(ends), rounded), p.alpha, p.beta, p.max_gap, p.min_gap)
    scaffolds = materialize(chunks.assemble(pieces, fasta.last_chunks(bases)).withColumnRenamed("chain", "no"), "scaffolds")
    return Stages(reads, merged, extracted, contigs, entries, vertices, edges, communities, members, pairs, links, chains, weights, scaffolds, seen)


def write(stages: Stages, folder: str) -> None:
    """Text files of all stages under ``folder``, each as a folder of parts in order."""
    x = interchange
    write_lines(x.merged_lines(stages.merged, stages.reads), f"{folder}/merged", ["seen"])
    write_lines(x.extracted_lines(stages.extracted), f"{folder}/extracted", ["seen"])
    write_lines(fasta.length_lines(stages.contigs), f"{folder}/lengths", [ROW_ID])
    write_lines(x.hyperedge_lines(hypergraph.labelled(stages.entries)), f"{folder}/hyperedges", ["line"])
    write_lines(x.adjacency_lines(hypergraph.adjacency(stages.graph)), f"{folder}/graph", ["v", "rank"])
    write_lines(x.community_lines(stages.communities), f"{folder}/communities", ["label"])
    write_lines(x.chain_lines(stages.chains), f"{folder}/chains", ["partition", "chain_no"])
    write_lines(x.weight_lines(stages.contig_weights), f"{folder}/weights", ["a", "b"])
    fasta.write_fasta(stages.scaffolds, f"{folder}/scaffolds")
