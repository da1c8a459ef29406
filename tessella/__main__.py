"""``python -m tessella --paf reads.paf --contig contigs.fa --output_dir out``, or one stage: ``python -m tessella merge ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tessella.operators.community import METHODS
from tessella.plans import pipeline, stages
from tessella.plans.materialize import steps
from tessella.plans.pipeline import Parameters
from tessella.plans.ship import ship


def parser() -> argparse.ArgumentParser:
    d = Parameters()
    p = argparse.ArgumentParser(prog="tessella", description="Scaffold contigs by multi-contact long reads.", epilog=f"Single stages: {', '.join(STAGES)}; each has its own --help.")
    p.add_argument("--paf", required=True, help="alignments of reads to contigs")
    p.add_argument("--contig", required=True, help="contigs, FASTA")
    p.add_argument("--output_dir", required=True, help="a new folder for the text of every stage")
    p.add_argument("-q", "--min_quality", type=int, default=d.min_quality)
    p.add_argument("--min_w", type=float, default=d.min_w, help="floor of both linking stages")
    p.add_argument("--drop_w", type=float, default=d.drop_w, help="accepted; cuts nothing in chains of two-ended contigs")
    p.add_argument("-r", "--resolution", type=float, default=d.resolution)
    p.add_argument("--random_seed", type=int, default=d.random_seed)
    p.add_argument("-s", "--alpha", type=float, default=d.alpha)
    p.add_argument("-e", "--beta", type=float, default=d.beta)
    p.add_argument("--max_gap", type=float, default=d.max_gap)
    p.add_argument("--min_gap", type=float, default=d.min_gap)
    p.add_argument("--vertex_factor", type=float, default=d.vertex_factor)
    p.add_argument("--weight_strategy", type=int, choices=(1, 2, 3), default=d.weight_strategy)
    p.add_argument("--weight_power", type=float, default=d.weight_power)
    p.add_argument("--filter_percentile", dest="percentile", type=float, default=d.percentile)
    p.add_argument("--min_degree", type=int, default=d.min_degree)
    p.add_argument("--method", choices=METHODS, default=d.method, help="of the communities")
    return p


def _stage(name: str, places: str, *options: tuple) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=f"tessella {name}", description=getattr(stages, name).__doc__)
    for place in places.split():
        p.add_argument(place)
    for flags, keywords in options:
        p.add_argument(*flags.split(), **keywords)
    return p


_GAPS = (("-s --alpha", {"type": float, "default": 0.4431}), ("-e --beta", {"type": float, "default": 4.0218}), ("--max_gap", {"type": float, "default": 100}), ("--min_gap", {"type": float, "default": 1}))
#: One command a stage; files come in the order of the function's arguments.
STAGES = {
    "merge": lambda: _stage("merge", "paf_path out", ("--min_quality", {"type": int, "default": stages.MERGE_QUALITY})),
    "extract": lambda: _stage("extract", "paf_path out", ("--min_quality", {"type": int, "default": stages.EXTRACT_QUALITY})),
    "lengths": lambda: _stage("lengths", "fasta_path out"),
    "hyperedges": lambda: _stage("hyperedges", "merged_path out", ("--factor", {"type": float, "default": 1.0})),
    "communities": lambda: _stage(
        "communities", "", ("-i --input", {"required": True, "dest": "hyperedge_path"}), ("-o --output", {"dest": "graph_out", "help": "the graph, as text"}), ("-c --communities", {"required": True, "dest": "out"}),
        ("-r --resolution", {"type": float, "default": 1.0}), ("--random_seed", {"type": int, "default": 42}), ("--weight_strategy", {"type": int, "choices": (1, 2, 3), "default": 1}), ("--weight_power", {"type": float, "default": 1.0}),
        ("--filter_percentile", {"type": float, "default": 10, "dest": "percentile"}), ("--min_degree", {"type": int, "default": 1}),
        ("--method", {"choices": METHODS, "default": "louvain"}),
    ),
    "link": lambda: _stage(
        "link", "contig_path partition_path extracted_path links_out weights_out", ("--min_edge_weight", {"type": float, "default": stages.LINK_FLOOR}),
        ("--weight_drop_threshold", {"type": float, "default": 0.3, "help": "accepted; cuts nothing in chains of two-ended contigs"}),
    ),
    "assemble": lambda: _stage("assemble", "contig_path chain_path weight_path out", *_GAPS),
    "rename": lambda: _stage("rename", "contig_path out", ("--prefix", {"default": "chr1_contig_"})),
}


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    name = argv[0] if argv and argv[0] in STAGES else None
    given = vars(STAGES[name]().parse_args(argv[1:]) if name else parser().parse_args(argv))
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    ship(spark)
    with steps(spark):
        if name:
            given.pop("weight_drop_threshold", None)
            print(json.dumps(getattr(stages, name)(spark, **given)))
        else:
            paf, contig, out = (given.pop(k) for k in ("paf", "contig", "output_dir"))
            done = pipeline.run(spark, paf, contig, Parameters(**given))
            pipeline.write(done, out)
            print(json.dumps(pipeline.report(done)))


if __name__ == "__main__":
    main()
