"""Stages of the scaffolding as jobs of their own, from text to text, with their own defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessella.operators import alignments as al
from tessella.operators import bins, chunks, community, hypergraph, linking, scaffold
from tessella.operators.numbering import numbered
from tessella.plans.materialize import materialize
from tessella.sources import fasta, interchange, paf
from tessella.sources.text import ROW_ID, reasons, scan_lines, write_lines
from tessella.sources.text import kept as lines_kept

MERGE_QUALITY, EXTRACT_QUALITY, LINK_FLOOR = 50, 60, 10.0


def observed(rows: DataFrame, name: str, **figures) -> tuple[DataFrame, Observation]:
    """``rows`` with figures that are taken while they are written, without a job of their own."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in figures.items()]), seen


def _scanned(rows: DataFrame, name: str, *why: str, **figures) -> tuple[DataFrame, Observation]:
    """A scan with its rejected lines, written once, and its counts: all lines, good rows and each reason."""
    seen = Observation(name)
    counts = reasons(*why)
    counted = rows.observe(seen, F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("reason").isNull(), 1)).alias("rows"), *[c.alias(k) for k, c in (counts | figures).items()])
    return materialize(counted, name), seen


def _rejected(seen: Observation, why: tuple[str, ...]) -> dict:
    return {k: seen.get[k] for k in why}


def merge(spark: SparkSession, paf_path: str, out: str, min_quality: int = MERGE_QUALITY) -> dict:
    """Alignments merged per (read, contig). Returns counts of what was read, kept and rejected, by reason."""
    rows, read = _scanned(paf.scan_alignments(spark, paf_path), "alignments", *paf.REASONS, good=F.count(F.when(F.col("reason").isNull() & (F.col("mapq") >= min_quality), 1)))
    good = materialize(al.quality_filter(lines_kept(rows), min_quality), "good")
    kept, left = observed(al.merge(good), "merged", length=F.sum("length"))
    kept = materialize(kept, "merged")
    write_lines(interchange.merged_lines(kept, al.reads_in_order(good)), out, ["seen"])
    return {"alignments": read.get["rows"], "rejected": _rejected(read, paf.REASONS), "good": read.get["good"], "merged": left.get["rows"], "length": left.get["length"] or 0}


def extract(spark: SparkSession, paf_path: str, out: str, min_quality: int = EXTRACT_QUALITY) -> dict:
    """Placements of reads with two good ones or more. Averages are given over all reads and over the kept."""
    rows, read = _scanned(paf.scan_placements(spark, paf_path), "placements", *paf.REASONS)
    rows = lines_kept(rows)
    kept, left = observed(al.extract(rows, min_quality), "extracted")
    kept = materialize(kept, "extracted")
    write_lines(interchange.extracted_lines(kept), out, ["seen"])
    n, reads = (x.agg(F.countDistinct("read")).first()[0] for x in (rows, kept))
    return {
        "placements": read.get["rows"], "rejected": _rejected(read, paf.REASONS), "reads": n, "kept": left.get["rows"], "kept_reads": reads,
        "per_read": read.get["rows"] / n if n else 0.0, "per_kept_read": left.get["rows"] / reads if reads else 0.0,
    }


def lengths(spark: SparkSession, fasta_path: str, out: str) -> dict:
    records, seen = observed(fasta.records(fasta.read_fasta_chunks(spark, fasta_path)), "contigs", total=F.sum("length"), least=F.min("length"), most=F.max("length"))
    write_lines(fasta.length_lines(materialize(records, "contigs")), out, [ROW_ID])
    got = seen.get
    return {"contigs": got["rows"], "total": got["total"] or 0, "least": got["least"], "most": got["most"], "mean": got["total"] / got["rows"] if got["rows"] else 0.0}


def hyperedges(spark: SparkSession, merged_path: str, out: str, factor: float = 1.0) -> dict:
    """Hyperedges of the entries that pass the filter, in the order of the reads. A factor that is not positive counts as 1.

    ``single`` counts reads with one entry, ``filtered`` the entries that are left out, ``unnumbered``
    the hyperedges with a name that has no number: they are written, and left out by whoever reads them.
    """
    rows, read = _scanned(interchange.scan_merged(scan_lines(spark, merged_path)), "entries", *interchange.MERGED_REASONS)
    rows = lines_kept(rows).select("read", "contig", F.col("length").alias("weight"), F.col(ROW_ID).alias("first"))
    reads = materialize(rows.groupBy("read").agg(F.min("first").alias("seen"), F.count("*").alias("n")), "reads")
    kept, left = observed(hypergraph.labelled(hypergraph.vertex_filter(rows, factor).join(reads.select("read", "seen"), "read")), "vertices")
    kept = materialize(kept, "vertices")
    write_lines(interchange.hyperedge_lines(kept), out, ["line"])
    n = reads.agg(F.count("*").alias("reads"), F.count(F.when(F.col("n") == 1, 1)).alias("single")).first()
    per = kept.groupBy("read").agg(F.count(F.when(F.col("vertex").try_cast("long").isNull(), 1)).alias("odd")).agg(F.count("*").alias("n"), F.count(F.when(F.col("odd") > 0, 1)).alias("odd")).first()
    return {
        "entries": read.get["rows"], "rejected": _rejected(read, interchange.MERGED_REASONS), "vertices": left.get["rows"], "filtered": read.get["rows"] - left.get["rows"], "reads": n["reads"], "hyperedges": per["n"], "single": n["single"], "unnumbered": per["odd"],
    }


def communities(
    spark: SparkSession, hyperedge_path: str, out: str, graph_out: str | None = None, resolution: float = 1.0, random_seed: int = 42,
    weight_strategy: int = hypergraph.GEOMETRIC, weight_power: float = 1.0, percentile: float = 10, min_degree: int = 1, method: str = "louvain",
) -> dict:
    lines, read = _scanned(interchange.scan_hyperedges(scan_lines(spark, hyperedge_path)), "lines", *interchange.HYPEREDGE_REASONS)
    vertices = materialize(interchange.hyperedges_of(lines), "vertices")
    held = materialize(hypergraph.lists(vertices, weight_strategy, weight_power), "lists")
    every, pairs = observed(hypergraph.project(held, seen=True), "pairs")
    every = materialize(every, "pairs")
    edges, kept = observed(hypergraph.top_up(hypergraph.percentile_filter(every, percentile), every, min_degree), "edges")
    edges = materialize(edges, "edges")
    seen = materialize(hypergraph.first_sight(vertices), "seen")
    found = materialize(community.relabel(community.grouped(edges, seen, method, resolution, random_seed), seen), "communities")
    write_lines(interchange.community_lines(found), out, ["label"])
    if graph_out:
        write_lines(interchange.adjacency_lines(hypergraph.adjacency(edges)), graph_out, ["v", "rank"])
    return {"hyperedges": read.get["rows"], "rejected": _rejected(read, interchange.HYPEREDGE_REASONS), "pairs": pairs.get["rows"], "edges": kept.get["rows"], **community.stats(found).first().asDict()}


def link(spark: SparkSession, contig_path: str, partition_path: str, extracted_path: str, links_out: str, weights_out: str, min_edge_weight: float = LINK_FLOOR) -> dict:
    """Chains and contig weights. Contigs may be given as sequences or as written lengths: names alone are read."""
    names = fasta.read_fasta(spark, contig_path).groupBy(F.col("name").alias("contig")).agg(F.min(ROW_ID).alias("ord"))
    parts = interchange.read_partitions(spark, partition_path).select("partition", F.col("vertex").alias("number"))
    members = materialize(bins.assign_partitions(names, parts).withColumn("ord", F.col("number").cast("long")), "members")
    lines, read = _scanned(interchange.scan_extracted(scan_lines(spark, extracted_path)), "lines", *interchange.EXTRACTED_REASONS)
    places = bins.of_members(lines_kept(lines), members)
    pairs, seen = observed(bins.pair_weights(bins.coverage(bins.end_bins(places))), "pairs")
    pairs, held = materialize(pairs, "ends"), members.select("partition", "contig")
    sim, cov = (linking.candidate_edges(pairs.withColumn("w", F.col(c)), members, min_edge_weight) for c in ("sim", "cov"))
    links, took = observed(linking.two_phase(linking.greedy_path_cover(sim, held), linking.greedy_path_cover(cov, held), held), "links")
    chains = materialize(linking.chains(materialize(links, "links"), members), "chains")
    write_lines(interchange.chain_lines(chains), links_out, ["partition", "chain_no"])
    write_lines(interchange.weight_lines(bins.contig_weights(pairs, members.select("contig", "number"))), weights_out, ["a", "b"])
    # Of contigs that share a number only the first has a place.
    shared = bins.duplicate_suffixes(names).count()
    return {"members": members.count(), "shared_numbers": shared, "placements": read.get["rows"], "rejected": _rejected(read, interchange.EXTRACTED_REASONS), "pairs": seen.get["rows"], "links": took.get["rows"], "chains": chains.select("partition", "chain_no").distinct().count()}


def assemble(
    spark: SparkSession, contig_path: str, chain_path: str, weight_path: str, out: str,
    alpha: float = scaffold.ALPHA, beta: float = scaffold.BETA, max_gap: float = scaffold.MAX_GAP, min_gap: float = scaffold.MIN_GAP,
) -> dict:
    ends = materialize(interchange.read_chains(spark, chain_path), "ends")
    order = numbered(ends.select(F.col(ROW_ID)).distinct(), [F.asc(ROW_ID)], "no")
    ends = materialize(ends.join(order, ROW_ID).select(F.col("no").alias("chain"), "pos", "endpoint"), "chain_ends")
    weights = interchange.read_weights(spark, weight_path)
    pieces = scaffold.gaps(scaffold.pair_lookup(scaffold.in_order(ends), weights), alpha, beta, max_gap, min_gap)
    bases = materialize(fasta.read_fasta_chunks(spark, contig_path), "bases")
    done, seen = observed(chunks.assemble(pieces, fasta.last_chunks(bases)), "scaffolds", bases=F.sum(F.length("bases").cast("long")), scaffolds=F.count(F.when(F.col("block") == 0, 1)))
    fasta.write_fasta(materialize(done.withColumnRenamed("chain", "no"), "scaffolds"), out)
    return {"scaffolds": seen.get["scaffolds"], "bases": seen.get["bases"] or 0}


def rename(spark: SparkSession, contig_path: str, out: str, prefix: str = "chr1_contig_") -> dict:
    """Contigs numbered in file order, sequences in upper case."""
    rows, seen = observed(fasta.renamed(fasta.read_fasta(spark, contig_path), prefix), "contigs")
    rows = materialize(rows, "renamed")
    write_lines(rows.select(ROW_ID, F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")), out, [ROW_ID])
    return {"contigs": seen.get["rows"]}
