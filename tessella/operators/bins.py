"""Coverage of contig ends in bins, and pair weights between ends that share reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.sequences import cosine
from tessella.operators.tiles import pairs_within
from tessella.plans.materialize import materialize

BIN_LENGTHS = (400, 1000, 2000, 5000, 10_000, 20_000)
BINS = 5
FRONT, BACK = 1, 2


def end_bins(placements: DataFrame, lengths: Sequence[int] = BIN_LENGTHS, bins: int = BINS, mirrored: bool = False) -> DataFrame:
    """(bin_length, read, contig, side, lo, hi): bins that each placement covers at either end.

    The front window is the first bins * L bases, the back window the last; a placement's
    overlap with it is plain arithmetic. Bins count from the window's start on both sides,
    so on the back the last one is outermost; ``mirrored`` counts them from the contig's
    end. All sizes and both sides come from one pass.
    """
    size = F.explode(F.array(*[F.lit(int(x)) for x in lengths])).alias("bin_length")
    held = placements.select("*", size).withColumn("side", F.explode(F.array(F.lit(FRONT), F.lit(BACK))))
    span, t_len = F.col("bin_length") * bins, F.col("t_len")
    begin = F.when(F.col("side") == FRONT, F.lit(0)).otherwise(F.greatest(F.lit(0), t_len - span))
    end = F.when(F.col("side") == FRONT, F.least(span.cast("long"), t_len)).otherwise(t_len)
    cut = held.withColumns({"begin": begin.cast("long"), "lo": F.greatest(F.col("t_start"), begin), "hi": F.least(F.col("t_end"), end)}).filter("lo < hi")
    first = F.floor((F.col("lo") - F.col("begin")) / F.col("bin_length"))
    last = F.least(F.floor((F.col("hi") - F.col("begin") - 1) / F.col("bin_length")), F.lit(bins - 1))
    out = cut.withColumns({"b0": first.cast("int"), "b1": last.cast("int")})
    if mirrored:
        flip = F.col("side") == BACK
        lo, hi = F.when(flip, bins - 1 - F.col("b1")).otherwise(F.col("b0")), F.when(flip, bins - 1 - F.col("b0")).otherwise(F.col("b1"))
        out = out.withColumns({"b0": lo, "b1": hi})
    return out.select("bin_length", "read", "contig", "side", F.col("b0").alias("lo"), F.col("b1").alias("hi"))


def of_members(placements: DataFrame, members: DataFrame) -> DataFrame:
    """Placements on contigs that ``members`` (contig, ...) has; each once, however often it has them."""
    return placements.join(members.select("contig"), "contig", "left_semi")


def coverage(end_bins_: DataFrame) -> DataFrame:
    """(bin_length, read, contig, side, cnt, mask): bins counted with repeats, and as a bit set."""
    n = F.greatest(F.col("hi") - F.col("lo") + 1, F.lit(0))
    mask = F.when(n > 0, F.expr("shiftleft(shiftleft(1, hi - lo + 1) - 1, lo)")).otherwise(0)
    held = end_bins_.select("bin_length", "read", "contig", "side", n.alias("n"), mask.alias("m"))
    return held.groupBy("bin_length", "read", "contig", "side").agg(F.sum("n").alias("cnt"), F.bit_or("m").alias("mask"))


def similarity(mask_a: Column, mask_b: Column) -> Column:
    """Cosine of two 0/1 vectors given as bit sets."""
    dot = F.bit_count(mask_a.bitwiseAND(mask_b)).cast("double")
    return cosine(dot, F.bit_count(mask_a).cast("double"), F.bit_count(mask_b).cast("double"))


def endpoint(contig: str = "contig", side: str = "side") -> Column:
    return F.concat_ws("_", F.col(contig).cast("string"), F.col(side).cast("string"))


def pair_weights(cover: DataFrame, similarity_factor: float = 1.0, coverage_factor: float = 1.0) -> DataFrame:
    """(ep_a, ep_b, contig_a, contig_b, sim, cov) with ep_a < ep_b, over all bin sizes and reads.

    sim sums cosines of the bit sets, cov the square roots of products of counts. Both come
    from one join inside (bin_length, read), summed before the shuffle; reads over very many
    ends are joined tile by tile.
    """
    # Read for the sizes of the groups and for either side of the join.
    own = materialize(cover.withColumn("ep", endpoint()).select("bin_length", "read", "ep", "contig", "cnt", "mask"), "cover")
    pairs = pairs_within(own, ["bin_length", "read"], "ep", ["contig", "cnt", "mask"])
    sim = similarity(F.col("mask"), F.col("mask_b")) * F.lit(similarity_factor)
    cov = F.sqrt((F.col("cnt") * F.col("cnt_b")).cast("double")) * F.lit(coverage_factor)
    return pairs.groupBy(F.col("ep").alias("ep_a"), F.col("ep_b"), F.col("contig").alias("contig_a"), F.col("contig_b")).agg(
        F.sum(sim).alias("sim"), F.sum(cov).alias("cov")
    )


def contig_weights(pairs: DataFrame, numbers: DataFrame) -> DataFrame:
    """(a, b, weight): sim + cov of all ends of two contigs, keyed by their numbers as text.

    ``numbers`` has (contig, number); contigs without one take no part. The lesser number
    in the order of strings stands first.
    """
    total = F.col("sim") + F.col("cov")
    held = pairs.filter((F.col("contig_a") != F.col("contig_b")) & (total > 0)).withColumn("t", total)
    for side in "ab":
        held = held.join(numbers.select(F.col("contig").alias(f"contig_{side}"), F.col("number").cast("string").alias(f"n{side}")), f"contig_{side}")
    return held.groupBy(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).agg(F.sum("t").alias("weight"))


def assign_partitions(contigs: DataFrame, partitions: DataFrame) -> DataFrame:
    """(partition, number, contig): the first contig in order whose name ends in _number.

    ``contigs`` has (contig, ord), ``partitions`` (partition, number as text). A contig
    without an underscore matches nothing.
    """
    ends = contigs.filter(F.contains("contig", F.lit("_"))).groupBy(F.substring_index("contig", "_", -1).alias("number")).agg(F.min_by("contig", "ord").alias("contig"))
    return partitions.select("partition", F.col("number").cast("string").alias("number")).join(ends, "number").select("partition", "number", "contig")


def duplicate_suffixes(contigs: DataFrame) -> DataFrame:
    """(number, n): last name segments that several contigs share, of which only the first is used."""
    return contigs.groupBy(F.substring_index("contig", "_", -1).alias("number")).agg(F.count("*").alias("n")).filter("n > 1")
