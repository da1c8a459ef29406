"""Orientation and assembly of chains into scaffolds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.sequences import digit_segment, gap_length, stem
from tessella.operators import chunks, hubs
from tessella.plans.materialize import materialize

ALPHA, BETA, MAX_GAP, MIN_GAP = 0.4431, 4.0218, 100, 1


def _forward(first: Column, second: Column, two: Column) -> Column:
    """Whether a pair of ends is forward; an error unless there are ``two`` of them and they are one contig's."""
    a, b = F.substring_index(first, "_", -1), F.substring_index(second, "_", -1)

    def fail(text: str) -> Column:
        return F.raise_error(F.concat(F.lit(text), F.col("chain").cast("string"))).cast("boolean")

    return (
        F.when(~two, fail("odd number of ends in chain "))
        .when(stem(first) != stem(second), fail("ends of two contigs in one pair in chain "))
        .when((a == "1") & (b == "2"), F.lit(True))
        .when((a == "2") & (b == "1"), F.lit(False))
        .otherwise(fail("ends that are no pair in chain "))
    )


def oriented(chain_ends: DataFrame) -> DataFrame:
    """(chain, piece, contig, forward) from (chain, pos, endpoint), two ends per contig.

    ``_1`` then ``_2`` is forward, the other way round reversed. An odd number of ends, two
    contigs in one pair or any other sides are errors.
    """
    pair = F.floor(F.col("pos") / 2)
    held = chain_ends.groupBy("chain", pair.alias("piece")).agg(F.array_sort(F.collect_list(F.struct("pos", "endpoint"))).alias("e"))
    first, second = F.get("e", F.lit(0))["endpoint"], F.get("e", F.lit(1))["endpoint"]
    return held.select("chain", "piece", stem(first).alias("contig"), _forward(first, second, F.size("e") == 2).alias("forward"))


def pieces_in_order(chain_ends: DataFrame, together: bool = False) -> DataFrame:
    """``oriented`` with ``number``, that of the contig, and ``before``, that of the contig before in the chain, else null.

    ``together`` says that a chain's ends are in one partition and are no hub's, as of ``hubs.gathered``; then
    nothing is shuffled, and ends are sorted once.
    """
    number = digit_segment(F.col("contig"))
    if together:
        inside = Window.partitionBy("chain").orderBy("pos")
        held = chain_ends.select("chain", "pos", F.floor(F.col("pos") / 2).alias("piece"), "endpoint")
        beside = {"__first": F.coalesce(F.lag("piece").over(inside) != F.col("piece"), F.lit(True)), "__second": F.lead("endpoint").over(inside)}
        # The next end is the same pair's and the one after that is not.
        two = F.lead("piece").over(inside).eqNullSafe(F.col("piece")) & ~F.lead("piece", 2).over(inside).eqNullSafe(F.col("piece"))
        held = held.withColumns(beside | {"__two": two}).filter("__first")
        forward = _forward(F.col("endpoint"), F.col("__second"), F.col("__two"))
        held = held.select("chain", "pos", "piece", stem(F.col("endpoint")).alias("contig"), forward.alias("forward")).withColumn("number", number)
        before = F.when(F.lag("piece").over(inside) == F.col("piece") - 1, F.lag("number").over(inside))
        return held.withColumn("before", before).drop("pos")
    # A join and no window, so that a very long chain is not one task's.
    held = materialize(oriented(chain_ends).withColumn("number", number), "pieces")
    after = held.select("chain", (F.col("piece") + 1).alias("piece"), F.col("number").alias("before"))
    return held.join(after, ["chain", "piece"], "left")


def in_order(chain_ends: DataFrame) -> DataFrame:
    """``pieces_in_order`` of chains of any length; ``chain_ends`` are read twice, so write them first."""
    return hubs.gathered(chain_ends, "chain", pieces_in_order)


def pair_lookup(pieces: DataFrame, weights: DataFrame) -> DataFrame:
    """(chain, piece, contig, forward, first, w_before) from ``pieces_in_order``: the weight with the contig before, else null.

    ``first`` is true where there is none before. ``weights`` has (a, b, weight) of contig numbers
    in either order, positive; of several for two contigs the largest counts.
    """
    # First pieces look nothing up. Half of their key is null, which meets nothing, the other deals them out.
    first = F.col("before").isNull()
    lo = F.when(first, F.pmod(F.xxhash64("chain"), F.lit(hubs.COUNTS))).otherwise(F.least("number", "before"))
    hi = F.when(~first, F.greatest("number", "before"))
    table = weights.filter("weight > 0").groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.max("weight").alias("w_before"))
    held = pieces.select("chain", "piece", "contig", "forward", lo.alias("lo"), hi.alias("hi")).join(table, ["lo", "hi"], "left")
    return held.select("chain", "piece", "contig", "forward", F.col("hi").isNull().alias("first"), "w_before")


def gaps(pieces: DataFrame, alpha: float = ALPHA, beta: float = BETA, max_gap: float = MAX_GAP, min_gap: float = MIN_GAP) -> DataFrame:
    """(chain, piece, contig, forward, gap): bases of N before the piece, 0 before a chain's first."""
    w = F.coalesce("w_before", F.lit(0.0))
    return pieces.select("chain", "piece", "contig", "forward", F.when(F.col("first"), F.lit(0)).otherwise(gap_length(w, alpha, beta, max_gap, min_gap)).alias("gap"))


def assemble(pieces: DataFrame, sequences: DataFrame) -> DataFrame:
    """(chain, n_contigs, seq) from (chain, piece, contig, forward, gap) and (name, seq).

    For chains that fit in a value each; ``chunks.assemble`` has them in rows of bounded size.
    A contig without a sequence is an error.
    """
    rows = chunks.laid(pieces, chunks.chunked(sequences))
    part = F.coalesce("bases", F.repeat(F.lit("N"), F.col("n").cast("int")))
    held = rows.groupBy("chain").agg(F.max("nth").alias("n_contigs"), F.sort_array(F.collect_list(F.struct("at", part.alias("part")))).alias("x"))
    return held.select("chain", "n_contigs", F.array_join(F.transform("x", lambda x: x["part"]), "").alias("seq"))


def unplaced(contigs: DataFrame, pieces: DataFrame) -> DataFrame:
    """Contigs that are in no chain."""
    return contigs.join(pieces.select(F.col("contig").alias("name")), "name", "left_anti")
