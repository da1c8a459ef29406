"""Sequences as rows of bounded size: (name, at, bases), a piece of the sequence and its offset.

Lengths, reverse complements, chains of contigs with gaps and lines of text are arithmetic on
offsets, so no sequence is ever one value. A sequence without bases has one empty row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.sequences import reverse_complement
from tessella.operators.numbering import running
from tessella.plans.materialize import materialize

#: Bases of a row, and lines of text of a block.
CHUNK, WIDTH, BLOCK_LINES = 1 << 20, 80, 1 << 13


def chunked(sequences: DataFrame, size: int = CHUNK) -> DataFrame:
    """(name, at, bases) from (name, seq)."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(size))
    rows = sequences.select("name", "seq", F.explode(starts).alias("at"))
    return rows.select("name", F.col("at").cast("long").alias("at"), F.substring("seq", F.col("at") + 1, F.lit(size)).alias("bases"))


def lengths(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("name").agg(F.sum(F.length("bases").cast("long")).alias("length"))


def turned(chunks: DataFrame, lengths_: DataFrame | None = None) -> DataFrame:
    """The reverse complement of every sequence, row by row: the last row's end comes first."""
    held = chunks.join(lengths(chunks) if lengths_ is None else lengths_.select("name", "length"), "name")
    return held.select("name", (F.col("length") - F.col("at") - F.length("bases")).alias("at"), reverse_complement(F.col("bases")).alias("bases"))


def _cut(rows: DataFrame, key: str, n: Column, part, block: int) -> DataFrame:
    """(key, block, at, part): rows of ``n`` bases from ``at`` on, cut where blocks end."""
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.greatest(n, F.lit(1)) - 1) / block)
    held = rows.withColumn("block", F.explode(F.sequence(first, last)))
    lo, hi = F.greatest("at", F.col("block") * block), F.least(F.col("at") + n, (F.col("block") + 1) * block)
    return held.select(key, "block", lo.alias("at"), part(lo - F.col("at"), hi - lo).alias("part"))


def _joined(cut: DataFrame, key: str) -> DataFrame:
    parts = F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])
    return cut.groupBy(key, "block").agg(F.array_join(parts, "").alias("bases"))


def _bases(start: Column, n: Column) -> Column:
    return F.substring("bases", (start + 1).cast("int"), n.cast("int"))


def blocks(chunks: DataFrame, block: int = WIDTH * BLOCK_LINES) -> DataFrame:
    """(name, block, bases): block k has the bases from k * block on; only the last one is shorter."""
    return _joined(_cut(chunks, "name", F.length("bases"), _bases, block), "name")


def laid(pieces: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chain, nth, at, n, bases) of chains: the rows of contigs and, with null bases, the gaps, each with its place in the chain.

    ``pieces`` and ``chunks`` are as in ``assemble``. ``nth`` is the number of the piece, from 1 on. Where ``chunks``
    are few enough for a broadcast the rows stay by chain.
    """
    held = pieces.join(lengths(chunks).withColumnRenamed("name", "contig"), "contig", "left")
    length = F.coalesce("length", F.raise_error(F.concat(F.lit("no sequence for contig "), "contig")).cast("long"))
    held = held.select("chain", "piece", "contig", "forward", F.col("gap").cast("long").alias("gap"), length.alias("length"))
    placed = running(held, ["chain"], ["piece"], {"begin": F.col("gap") + F.col("length")}, "nth")
    # Stretches of a large contig are told apart in the join's key; the gap before it is a row without one, which meets nothing.
    own = F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / CHUNK))
    stretch = F.explode(F.when(F.col("gap") > 0, F.concat(F.array(F.lit(None).cast("long")), own)).otherwise(own)).alias("stretch")
    wanted = placed.select("chain", "nth", "forward", F.col("contig").alias("name"), "begin", "gap", "length", stretch)
    rows = wanted.join(chunks.withColumn("stretch", F.floor(F.col("at") / CHUNK)), ["name", "stretch"], "left")
    empty = F.col("stretch").isNull()
    n = F.length("bases")
    at = F.when(F.col("forward"), F.col("at")).otherwise(F.col("length") - F.col("at") - n)
    bases = F.when(F.col("forward"), F.col("bases")).otherwise(reverse_complement(F.col("bases")))
    return rows.filter(empty | F.col("bases").isNotNull()).select(
        "chain", "nth", F.when(empty, F.col("begin")).otherwise(F.col("begin") + F.col("gap") + at).alias("at"), F.when(empty, F.col("gap")).otherwise(n).alias("n"), bases.alias("bases")
    )


def assemble(pieces: DataFrame, chunks: DataFrame, block: int = WIDTH * BLOCK_LINES) -> DataFrame:
    """(chain, block, bases) of chains from (chain, piece, contig, forward, gap) and the contigs' (name, at, bases).

    A piece begins where the pieces before it and their gaps end. Rows of contigs are joined by
    name and stretch, turned where they lie and cut at the ends of blocks. A contig without a
    sequence is an error. Every contig has a row, so a chain of nothing but empty ones has its first block.
    """

    def part(start: Column, n: Column) -> Column:
        return F.coalesce(_bases(start, n), F.repeat(F.lit("N"), n.cast("int")))

    return _joined(_cut(laid(pieces, chunks), "chain", F.col("n"), part, block), "chain")
