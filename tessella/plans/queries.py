"""Registered queries: the reference's operators over the given tables, and their SQL.

The tables hold no alignments, so line items stand in for them: an order is a read, a
supplier a contig, the quantity a weight, and prices give places on a contig. Documents
stand in for sequence records, and customers for named contigs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import sequences as sq
from tessella.operators import alignments as al
from tessella.operators import bins, chunks, community, hubs, hypergraph, linking, scaffold, spectral
from tessella.operators.components import connected_components
from tessella.operators.numbering import numbered, running
from tessella.plans.materialize import materialize, new_path
from tessella.sources import fasta, interchange, paf
from tessella.sources.text import rejected, write_lines

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: A full-row order: (l_orderkey, l_linenumber) is not unique.
ORDER = ("l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
SQL_ORDER = f"({', '.join(ORDER)})"
#: Text of an alignment row, common to both engines.
PLACED = """l_orderkey AS read, 'c_contig_' || l_suppkey AS contig, l_suppkey AS vertex, CAST(l_quantity AS BIGINT) AS q,
  20000 + 10 * l_suppkey AS t_len, CAST(floor(l_extendedprice) AS BIGINT) % (20000 + 10 * l_suppkey) AS t_start"""


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def alignments(spark: SparkSession, d: str) -> DataFrame:
    """read, contig, vertex, q_start, q_end, strand, t_len, t_start, t_end, mapq, row_id."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("read"),
        F.concat(F.lit("c_contig_"), F.col("l_suppkey").cast("string")).alias("contig"),
        F.col("l_suppkey").alias("vertex"),
        F.col("l_quantity").cast("long").alias("q"),
        (20000 + 10 * F.col("l_suppkey")).alias("t_len"),
        (F.floor("l_extendedprice") % (20000 + 10 * F.col("l_suppkey"))).alias("t_start"),
        F.col("l_returnflag").alias("strand"),
        F.struct(*ORDER).alias("row_id"),
    )
    return rows.select(
        "read", "contig", "vertex", "t_len", "t_start", "strand", "row_id",
        F.lit(0).cast("long").alias("q_start"), (10 * F.col("q")).alias("q_end"), F.least("t_len", F.col("t_start") + 100 * F.col("q")).alias("t_end"), (F.col("q") + 20).alias("mapq"),
    )


SQL_ALN = f"""aln AS (SELECT read, contig, vertex, t_len, t_start, least(t_len, t_start + 100 * q) AS t_end, 0 AS q_start, 10 * q AS q_end, q + 20 AS mapq, l_returnflag AS strand, {', '.join(ORDER)}
  FROM (SELECT *, {PLACED} FROM lineitem))"""


# ------------------------------------------------------------------ alignments


@query("alignment_quality_filter", f"WITH {SQL_ALN} SELECT read, contig, q_end - q_start AS length, mapq FROM aln WHERE mapq >= 60")
def alignment_quality_filter(spark, d):
    return al.quality_filter(alignments(spark, d)).select("read", "contig", "length", "mapq")


SQL_MERGED = f"""merged AS (SELECT read, contig, any_value(vertex) AS vertex, sum(q_end - q_start)::BIGINT AS length, arg_min(t_start, {SQL_ORDER}) AS t_start, arg_min(t_end, {SQL_ORDER}) AS t_end, arg_min(strand, {SQL_ORDER}) AS strand, min({SQL_ORDER}) AS first
  FROM aln WHERE mapq >= 30 GROUP BY read, contig HAVING sum(q_end - q_start) >= 100)"""


def merged(spark, d):
    return al.merge(al.quality_filter(alignments(spark, d), 30))


@query("read_contig_merge", f"WITH {SQL_ALN}, {SQL_MERGED} SELECT read, contig, t_start, t_end, strand, length FROM merged")
def read_contig_merge(spark, d):
    return merged(spark, d).select("read", "contig", "t_start", "t_end", "strand", "length")


@query(
    "multi_contact_reads",
    f"""WITH {SQL_ALN}, good AS (SELECT * FROM aln WHERE q_end >= 100 AND mapq >= 60)
SELECT read, count(*) AS n_contacts, string_agg(contig || '@' || t_start::VARCHAR, ' ' ORDER BY {', '.join(ORDER)}) AS contacts FROM good GROUP BY read HAVING count(*) >= 2""",
)
def multi_contact_reads(spark, d):
    held = al.contact_lists(al.extract(alignments(spark, d)))
    shown = F.array_join(F.transform("contacts", lambda c: F.concat(c["contig"], F.lit("@"), c["t_start"].cast("string"))), " ")
    return held.select("read", "n_contacts", shown.alias("contacts"))


@query(
    "alignment_run_counts",
    f"WITH {SQL_ALN}, {SQL_MERGED} SELECT (SELECT count(*) FROM aln) AS alignments, (SELECT count(DISTINCT read) FROM aln) AS reads, (SELECT count(*) FROM merged) AS merged, (SELECT count(DISTINCT read) FROM merged) AS kept_reads",
)
def alignment_run_counts(spark, d):
    return al.run_counts(alignments(spark, d), merged(spark, d))


# ------------------------------------------------------------------ hypergraph

SQL_KEPT = f"""{SQL_ALN}, {SQL_MERGED},
kept AS (SELECT read, vertex, length AS weight, first FROM (SELECT *, count(*) OVER r AS n, sum(length) OVER r AS total FROM merged WINDOW r AS (PARTITION BY read))
  WHERE n <= 1 OR length >= 0.5 * (total - length) / nullif(n - 1, 0))"""


def from_entries(spark, d, step):
    """``step(entries, together)``, entries being merged rows with their reads' rows in one partition but for hubs."""
    rows = al.quality_filter(alignments(spark, d), 30).select("read", "contig", "length", "row_id")

    def merged_first(rows, together):
        entries = al.merge(rows, carried=()).select("read", "contig", F.col("length").alias("weight"), "first")
        # Dealt in any way, entries are read twice, for the sums and for the rows.
        return step(entries if together else materialize(entries, "entries"), together)

    return hubs.gathered(rows, "read", merged_first)


def kept_entries(spark, d):
    return from_entries(spark, d, lambda entries, together: hypergraph.vertex_filter(entries, together=together))


def hyper_vertices(spark, d):
    return from_entries(spark, d, lambda entries, together: hypergraph.to_hyperedges(hypergraph.vertex_filter(entries, together=together), together))


def hyper_lists(spark, d):
    def step(entries, together):
        return hypergraph.lists(hypergraph.to_hyperedges(hypergraph.vertex_filter(entries, together=together), together))

    return materialize(from_entries(spark, d, step), "hyperedges")


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode("members").alias("vertex"))


SQL_FACTORS = "UNION ALL ".join(
    f"""SELECT {given}::DOUBLE AS factor, read, 'c_contig_' || vertex AS contig, length AS weight FROM (SELECT *, count(*) OVER r AS n, sum(length) OVER r AS total FROM merged WINDOW r AS (PARTITION BY read))
  WHERE n <= 1 OR length >= {used} * 0.5 * (total - length) / nullif(n - 1, 0) """
    for given, used in ((1.5, 1.5), (0.25, 0.25), (-1, 1.0))
)


@query("vertex_filter_factor", f"WITH {SQL_ALN}, {SQL_MERGED} {SQL_FACTORS}")
def vertex_filter_factor(spark, d):
    """The factor as an argument; what is not positive counts as 1."""
    def step(entries, together):
        # Each entry once, with the factors that it passes.
        marked = hypergraph.with_totals(entries.drop("first"), together=together)
        factors = F.array(*[F.when(hypergraph.passes(f), F.lit(float(f))) for f in (1.5, 0.25, -1)])
        return marked.select(F.explode(F.array_compact(factors)).alias("factor"), "read", "contig", F.col("weight").cast("long").alias("weight"))

    return from_entries(spark, d, step)


@query("hyperedge_vertex_filter", f"WITH {SQL_KEPT} SELECT read, 'c_contig_' || vertex AS contig, weight FROM kept")
def hyperedge_vertex_filter(spark, d):
    return kept_entries(spark, d).select("read", "contig", "weight")


def _sql_weights(expr: str) -> str:
    return f"WITH {SQL_KEPT}, ws AS (SELECT read AS edge_id, list(weight::DOUBLE ORDER BY first) AS w FROM kept GROUP BY read) SELECT edge_id, len(w) AS n_vertices, round({expr}, 4) AS weight FROM ws"


for _name, _strategy, _expr in (
    ("hyperedge_weight_geometric", hypergraph.GEOMETRIC, "pow(list_product(w), 1.0 / len(w))"),
    ("hyperedge_weight_arithmetic", hypergraph.ARITHMETIC, "list_avg(w)"),
    ("hyperedge_weight_harmonic", hypergraph.HARMONIC, "len(w) / list_sum(list_transform(w, lambda x: 1.0 / x))"),
):

    @query(_name, _sql_weights(_expr))
    def hyperedge_weight(spark, d, strategy=_strategy):
        out = hypergraph.weigh(hyper_vertices(spark, d), strategy)
        return out.withColumn("weight", F.round("weight", 4))


SQL_EDGES = f"""{SQL_KEPT}, ws AS (SELECT read, list_product(list(weight::DOUBLE ORDER BY first)) AS p, count(*) AS k FROM kept GROUP BY read),
edges AS (SELECT x.vertex AS a, y.vertex AS b, round(sum(pow(p, 1.0 / k)), 4) AS w FROM kept x JOIN kept y ON x.read = y.read AND x.vertex < y.vertex JOIN ws ON ws.read = x.read GROUP BY ALL)"""


def graph(spark, d):
    return hypergraph.project(hyper_lists(spark, d)).withColumn("w", F.round("w", 4))


@query("clique_projection", f"WITH {SQL_EDGES} SELECT a, b, w FROM edges")
def clique_projection(spark, d):
    return graph(spark, d)


@query("percentile_edge_filter", f"WITH {SQL_EDGES} SELECT a, b, w FROM edges WHERE w >= (SELECT quantile_cont(w, 0.1) FROM edges)")
def percentile_edge_filter(spark, d):
    return hypergraph.percentile_filter(materialize(graph(spark, d), "graph"))


@query("strongest_pairs", f"WITH {SQL_EDGES} SELECT a, b, w FROM edges WHERE w >= (SELECT quantile_cont(w, 0.9) FROM edges)")
def strongest_pairs(spark, d):
    return hypergraph.percentile_filter(materialize(graph(spark, d), "graph"), 90)


@query("weight_distribution", f"WITH {SQL_EDGES} SELECT min(w) AS min_w, max(w) AS max_w, round(avg(w), 4) AS mean_w, round(median(w), 4) AS median_w, count(*) AS n FROM edges")
def weight_distribution(spark, d):
    out = hypergraph.distribution(materialize(graph(spark, d), "graph"))
    return out.withColumns({c: F.round(c, 4) for c in ("mean_w", "median_w")})


SQL_BOTH = f"{SQL_EDGES}, arcs AS (SELECT a AS v, b AS neighbor, w AS weight FROM edges UNION ALL SELECT b, a, w FROM edges)"


@query("adjacency_sorted", f"WITH {SQL_BOTH} SELECT v, row_number() OVER (PARTITION BY v ORDER BY weight DESC, neighbor) AS rank, neighbor, weight FROM arcs")
def adjacency_sorted(spark, d):
    return hypergraph.adjacency(graph(spark, d))


@query("vertex_degrees", f"WITH {SQL_BOTH} SELECT v, count(*) AS degree FROM arcs GROUP BY v")
def vertex_degrees(spark, d):
    return hypergraph.degrees(graph(spark, d))


#: The pass in order: each turn takes the next short vertex, by the first pair that it is kept in; all edges so far
#: are carried on. Pairs stand in the order in which they are met, reads by number.
SQL_TOPUP = f"""WITH RECURSIVE {SQL_EDGES.replace("edges AS (", "edges AS MATERIALIZED (", 1)},
ranked AS (SELECT read, vertex, row_number() OVER (PARTITION BY read ORDER BY first, vertex) AS pos FROM kept),
met AS MATERIALIZED (SELECT least(x.vertex, y.vertex) AS a, greatest(x.vertex, y.vertex) AS b, min((x.read, x.pos, y.pos)) AS o FROM ranked x JOIN ranked y ON x.read = y.read AND x.pos < y.pos GROUP BY ALL),
arcs AS MATERIALIZED (SELECT a AS v, b AS n, w, o FROM edges JOIN met USING (a, b) UNION ALL SELECT b, a, w, o FROM edges JOIN met USING (a, b)),
base AS MATERIALIZED (SELECT a, b, w FROM edges WHERE w >= (SELECT quantile_cont(w, 0.97) FROM edges)),
short AS MATERIALIZED (SELECT v, row_number() OVER (ORDER BY min((o, side))) AS turn FROM (SELECT a AS v, 0 AS side, o FROM base JOIN met USING (a, b) UNION ALL SELECT b, 1, o FROM base JOIN met USING (a, b)) GROUP BY v HAVING count(*) < 5),
r(turn, a, b, w) AS (
  SELECT 0::BIGINT, a, b, w FROM base
  UNION ALL
  SELECT * FROM (
    SELECT turn + 1, a, b, w FROM r WHERE turn < (SELECT count(*) FROM short)
    UNION ALL
    SELECT turn, least(v, n), greatest(v, n), w FROM (
      SELECT s.turn, s.v, o.n, o.w, row_number() OVER (ORDER BY o.w DESC, o.o) AS k, (SELECT count(*) FROM r x WHERE x.a = s.v OR x.b = s.v) AS degree
      FROM short s JOIN arcs o ON o.v = s.v WHERE s.turn = (SELECT max(turn) + 1 FROM r) AND NOT EXISTS (SELECT 1 FROM r x WHERE x.a = least(s.v, o.n) AND x.b = greatest(s.v, o.n)))
    WHERE k <= 5 - degree))
SELECT a, b, w FROM r WHERE turn = (SELECT count(*) FROM short)"""


@query("min_degree_topup", SQL_TOPUP)
def min_degree_topup(spark, d):
    every = materialize(hypergraph.project(hyper_lists(spark, d), seen=True).withColumn("w", F.round("w", 4)), "graph")
    return hypergraph.top_up(hypergraph.percentile_filter(every, 97), every, 5)


# ------------------------------------------------------------------ communities


@query("community_detection")
def community_detection(spark, d):
    held = hyper_lists(spark, d)
    edges = materialize(hypergraph.percentile_filter(materialize(hypergraph.project(held), "graph")), "edges")
    seen = materialize(hypergraph.first_sight(held.select("line", F.posexplode("members").alias("pos", "vertex"))), "seen")
    return community.relabel(community.louvain(edges, seen), seen)


@query(
    "community_invariants",
    f"WITH {SQL_KEPT} SELECT count(DISTINCT vertex) AS vertices, count(DISTINCT vertex) AS placed, true AS each_once, true AS labels_in_order, true AS above_singletons, true AS not_below_one FROM kept",
)
def community_invariants(spark, d):
    """What holds of any communities that are worth the name, over all edges of the default percentile and up."""
    held = hyper_lists(spark, d)
    vertices = vertices_of(held)
    every = materialize(hypergraph.project(held), "graph")
    edges, nodes = materialize(hypergraph.percentile_filter(every), "edges"), materialize(vertices.select("vertex").distinct(), "nodes")
    found = materialize(community.relabel(community.louvain(edges, nodes)), "communities")
    alone, one = nodes.select("vertex", F.col("vertex").alias("label")), nodes.select("vertex", F.lit(0).alias("label"))
    ours, least, whole = (community.modularity(edges, x) for x in (found, alone, one))
    n = nodes.agg(F.count("*").alias("vertices"))
    out = found.agg(F.countDistinct("vertex").alias("placed"), (F.countDistinct("vertex") == F.count("*")).alias("each_once"), (F.countDistinct("label") == F.max("label") + 1).alias("labels_in_order"))
    return n.join(out).select("*", F.lit(ours > least).alias("above_singletons"), F.lit(ours >= whole - 1e-9).alias("not_below_one"))


@query(
    "nearest_rows",
    f"""WITH {SQL_EDGES}, cut AS MATERIALIZED (SELECT * FROM edges WHERE w >= (SELECT quantile_cont(w, 0.1) FROM edges)), arcs AS MATERIALIZED (SELECT a AS v, b AS u, w FROM cut UNION ALL SELECT b, a, w FROM cut),
norms AS MATERIALIZED (SELECT vertex AS v, coalesce(sum(w * w), 0)::FLOAT::DOUBLE AS sq FROM (SELECT DISTINCT vertex FROM kept) LEFT JOIN arcs ON v = vertex GROUP BY 1),
dots AS MATERIALIZED (SELECT x.v, y.v AS u, sum(x.w * y.w) AS dot FROM arcs x JOIN arcs y ON x.u = y.u AND x.v <> y.v GROUP BY ALL),
far AS (SELECT x.v, y.v AS u, y.sq, (x.sq + y.sq - 2 * coalesce(dot, 0))::FLOAT AS d FROM norms x JOIN norms y ON x.v <> y.v LEFT JOIN dots ON dots.v = x.v AND dots.u = y.v)
SELECT v, u, row_number() OVER (PARTITION BY v ORDER BY d, sq, u) AS rank FROM far QUALIFY rank <= 10""",
)
def nearest_rows(spark, d):
    """For each vertex the ten whose ties to all others are most like its own."""
    held = hyper_lists(spark, d)
    every = materialize(hypergraph.project(held).withColumn("w", F.round("w", 4)), "graph")
    near = spectral.nearest(hypergraph.percentile_filter(every), vertices_of(held), 10)
    return near.withColumn("rank", F.col("rank").cast("long"))


@query("spectral_invariants", f"WITH {SQL_KEPT} SELECT count(DISTINCT vertex) AS vertices, count(DISTINCT vertex) AS placed, true AS each_once, least(10, count(DISTINCT vertex) - 1) AS groups, true AS led_by_least FROM kept")
def spectral_invariants(spark, d):
    """The spectral way to communities, over all edges of the default percentile and up: every vertex is in one of ten groups."""
    held = hyper_lists(spark, d)
    every = materialize(hypergraph.project(held), "graph")
    nodes = materialize(vertices_of(held).distinct(), "nodes")
    found = materialize(spectral.spectral(hypergraph.percentile_filter(every), nodes), "spectral")
    least = found.groupBy("label").agg(F.min("vertex").alias("least")).agg(F.count("*").alias("groups"), F.min(F.col("least") == F.col("label")).alias("led_by_least"))
    placed = found.agg(F.countDistinct("vertex").alias("placed"), (F.countDistinct("vertex") == F.count("*")).alias("each_once"))
    return nodes.agg(F.count("*").alias("vertices")).join(placed).join(least)


def labelled(spark, d):
    """Communities given beforehand: suppliers by nation."""
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("label"), F.col("s_suppkey").alias("vertex"))


@query(
    "community_relabel",
    f"""WITH f AS (SELECT l_suppkey AS v, min((l_orderkey, {SQL_ORDER})) AS seen FROM lineitem GROUP BY 1),
s AS (SELECT s_nationkey AS old, count(*) AS n, min(s_suppkey) AS least, min(seen) AS seen FROM supplier LEFT JOIN f ON v = s_suppkey GROUP BY 1), o AS (SELECT old, row_number() OVER (ORDER BY n DESC, seen NULLS LAST, least) - 1 AS label FROM s)
SELECT label, s_suppkey AS vertex FROM supplier JOIN o ON s_nationkey = old""",
)
def community_relabel(spark, d):
    """Of nations with as many suppliers the one whose supplier the line items name first stands first."""
    seen = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("vertex")).agg(F.min(F.struct("l_orderkey", F.struct(*ORDER))).alias("seen"))
    return community.relabel(labelled(spark, d), seen)


@query(
    "community_stats",
    """WITH s AS (SELECT count(*) AS n FROM supplier GROUP BY s_nationkey)
SELECT count(*) AS n, max(n) AS max_size, min(n) AS min_size, round(avg(n), 6) AS mean_size, round(stddev_pop(n), 6) AS std_size, round((max(n) - min(n)) / avg(n), 6) AS spread FROM s""",
)
def community_stats(spark, d):
    return community.stats(labelled(spark, d)).withColumns({c: F.round(c, 6) for c in ("mean_size", "std_size", "spread")})


@query(
    "graph_components",
    """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS x, l_suppkey + 1000000000 AS y FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(node, component) USING KEY (node) AS (SELECT DISTINCT x, x FROM b UNION SELECT b.y, min(r.component) FROM r JOIN b ON r.node = b.x JOIN recurring.r AS u ON u.node = b.y WHERE r.component < u.component GROUP BY b.y)
SELECT node, component FROM r""",
)
def graph_components(spark, d):
    """All line items; the SQL spreads least labels, as the closure is too slow for them."""
    items = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return connected_components(items.select(F.col("o_custkey").alias("a"), (F.col("l_suppkey") + 1_000_000_000).alias("b")).distinct())


# ------------------------------------------------------------------ ends and bins


@query(
    "suffix_assignment",
    """WITH k AS (SELECT 'customer_' || (c_custkey % 2)::VARCHAR || '_' || (c_custkey // 2)::VARCHAR AS contig, min(c_custkey) AS ord FROM customer GROUP BY 1), e AS (SELECT split_part(contig, '_', -1) AS number, arg_min(contig, ord) AS contig FROM k GROUP BY 1)
SELECT s_nationkey AS partition, s_suppkey::VARCHAR AS number, contig FROM supplier JOIN e ON s_suppkey::VARCHAR = number""",
)
def suffix_assignment(spark, d):
    """Two names to every number, and as many numbers as the table gives."""
    names = F.expr("concat('customer_', c_custkey % 2, '_', c_custkey div 2)")
    contigs = table(spark, d, "customer").groupBy(names.alias("contig")).agg(F.min("c_custkey").alias("ord"))
    parts = table(spark, d, "supplier").select(F.col("s_nationkey").alias("partition"), F.col("s_suppkey").alias("number"))
    return bins.assign_partitions(contigs, parts)


@query("duplicate_suffixes", "SELECT split_part(p_name, '_', -1) AS number, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_suffixes(spark, d):
    return bins.duplicate_suffixes(table(spark, d, "part").select(F.col("p_name").alias("contig")))


@query(
    "placements_of_members",
    f"WITH {SQL_ALN} SELECT read, contig, t_start, t_end FROM aln WHERE mapq >= 60 AND q_end >= 100 AND vertex IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0)",
)
def placements_of_members(spark, d):
    """Placements on contigs that have a place in a partition; a contig that is there twice counts once."""
    held = table(spark, d, "supplier").filter("s_nationkey % 2 = 0").select(F.concat(F.lit("c_contig_"), F.col("s_suppkey").cast("string")).alias("contig"))
    return bins.of_members(al.extract(alignments(spark, d), least=1), held.unionByName(held)).select("read", "contig", "t_start", "t_end")


SQL_BINS = f"""{SQL_ALN}, placed AS (SELECT * FROM aln WHERE mapq >= 60),
win AS (SELECT bin_length, read, vertex, side, t_len, CASE side WHEN 1 THEN 0 ELSE greatest(0, t_len - 5 * bin_length) END AS begin,
  greatest(t_start, CASE side WHEN 1 THEN 0 ELSE greatest(0, t_len - 5 * bin_length) END) AS lo, least(t_end, CASE side WHEN 1 THEN least(5 * bin_length, t_len) ELSE t_len END) AS hi
  FROM placed, (SELECT unnest([400, 1000, 2000, 5000, 10000, 20000]) AS bin_length), (SELECT unnest([1, 2]) AS side)),
cut AS (SELECT bin_length, read, vertex, side, (lo - begin) // bin_length AS b0, least((hi - begin - 1) // bin_length, 4) AS b1 FROM win WHERE lo < hi),
cover AS (SELECT bin_length, read, vertex, side, sum(greatest(0, b1 - b0 + 1))::BIGINT AS cnt, bit_or(CASE WHEN b1 >= b0 THEN (((1 << (b1 - b0 + 1)::INT) - 1) << b0::INT) ELSE 0 END)::INT AS mask FROM cut GROUP BY ALL)"""


def cover(spark, d):
    rows = al.extract(alignments(spark, d), least=1)
    return bins.coverage(bins.end_bins(rows))


@query("end_bin_counts", f"WITH {SQL_BINS} SELECT bin_length, read, 'c_contig_' || vertex AS contig, side, cnt FROM cover")
def end_bin_counts(spark, d):
    return cover(spark, d).select("bin_length", "read", "contig", "side", "cnt")


@query("end_bin_masks", f"WITH {SQL_BINS} SELECT bin_length, read, 'c_contig_' || vertex AS contig, side, mask, bit_count(mask)::INT AS n_bins FROM cover")
def end_bin_masks(spark, d):
    return cover(spark, d).select("bin_length", "read", "contig", "side", "mask", F.bit_count("mask").alias("n_bins"))


SQL_PAIRS = f"""{SQL_BINS}, own AS (SELECT *, 'c_contig_' || vertex || '_' || side AS ep FROM cover),
pairs AS (SELECT x.ep AS ep_a, y.ep AS ep_b, any_value(x.vertex) AS va, any_value(y.vertex) AS vb,
  sum(CASE WHEN x.mask > 0 AND y.mask > 0 THEN bit_count(x.mask & y.mask) / (sqrt(bit_count(x.mask)) * sqrt(bit_count(y.mask))) ELSE 0 END) AS sim, sum(sqrt(x.cnt * y.cnt)) AS cov
  FROM own x JOIN own y ON x.bin_length = y.bin_length AND x.read = y.read AND x.ep < y.ep GROUP BY 1, 2)"""


def pairs(spark, d):
    return bins.pair_weights(cover(spark, d))


@query("endpoint_similarity", f"WITH {SQL_PAIRS} SELECT ep_a, ep_b, round(sim, 5) AS sim FROM pairs")
def endpoint_similarity(spark, d):
    return pairs(spark, d).select("ep_a", "ep_b", F.round("sim", 5).alias("sim"))


@query("endpoint_coverage", f"WITH {SQL_PAIRS} SELECT ep_a, ep_b, round(cov, 5) AS cov FROM pairs")
def endpoint_coverage(spark, d):
    return pairs(spark, d).select("ep_a", "ep_b", F.round("cov", 5).alias("cov"))


@query(
    "contig_pair_weight",
    f"WITH {SQL_PAIRS} SELECT least(va::VARCHAR, vb::VARCHAR) AS a, greatest(va::VARCHAR, vb::VARCHAR) AS b, round(sum(sim + cov), 4) AS weight FROM pairs WHERE va <> vb AND sim + cov > 0 GROUP BY 1, 2",
)
def contig_pair_weight(spark, d):
    numbers = table(spark, d, "supplier").select(F.concat(F.lit("c_contig_"), F.col("s_suppkey").cast("string")).alias("contig"), F.col("s_suppkey").alias("number"))
    return bins.contig_weights(pairs(spark, d), numbers).withColumn("weight", F.round("weight", 4))


# ------------------------------------------------------------------ linking


def members(spark, d):
    """Suppliers as contigs in three partitions."""
    s = table(spark, d, "supplier")
    return s.select((F.col("s_suppkey") % 3).alias("partition"), F.concat(F.lit("c_contig_"), F.col("s_suppkey").cast("string")).alias("contig"), F.col("s_suppkey").alias("ord"))


@query(
    "edge_dedupe",
    f"""WITH {SQL_PAIRS}, two AS (SELECT ep_a, ep_b, va, vb, round(sim, 5) AS w FROM pairs UNION ALL SELECT ep_a, ep_b, va, vb, round(cov, 5) FROM pairs)
SELECT va % 3 AS partition, least(ep_a, ep_b) AS a, greatest(ep_a, ep_b) AS b, max(w) AS w FROM two WHERE w > 0 AND va <> vb AND va % 3 = vb % 3 GROUP BY ALL""",
)
def edge_dedupe(spark, d):
    """At a floor of 0 all positive weights count, and pairs whose bins never meet, of similarity 0, do not."""
    p = pairs(spark, d)
    ends = ["ep_a", "ep_b", "contig_a", "contig_b"]
    both = p.select(*ends, F.round("sim", 5).alias("w")).unionByName(p.select(*ends, F.round("cov", 5).alias("w")))
    return linking.candidate_edges(both, members(spark, d), 0)


def _links(spark, d):
    """Accepted similarity edges, coverage edges and the merged ones."""
    p, m = materialize(pairs(spark, d), "pairs"), members(spark, d)
    held = m.select("partition", "contig")
    sim, cov = (linking.candidate_edges(p.withColumn("w", F.round(c, 5)), m) for c in ("sim", "cov"))
    sim, cov = linking.greedy_path_cover(sim, held), linking.greedy_path_cover(cov, held)
    return sim, cov, linking.two_phase(sim, cov, held)


SQL_MEMBERS = "members AS (SELECT s_suppkey % 3 AS partition, 'c_contig_' || s_suppkey AS contig, s_suppkey AS ord FROM supplier)"


def sql_candidates(name: str, measure: str, floor: float) -> str:
    return f"""{name} AS MATERIALIZED (SELECT va % 3 AS partition, least(ep_a, ep_b) AS a, greatest(ep_a, ep_b) AS b, max(round({measure}, 5)) AS w FROM pairs
  WHERE round({measure}, 5) >= {floor} AND va <> vb AND va % 3 = vb % 3 GROUP BY ALL)"""


def sql_cover(name: str, edges: str) -> str:
    """The greedy pass, one edge of every partition a step; each step carries all ends, their fragments and whether they are free."""
    return f"""{name}_s(it, partition, ep, frag, free, a, b, w) AS (
  SELECT 0, partition, contig || '_' || side, contig, true, NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE FROM members, (SELECT unnest([1, 2]) AS side)
  UNION ALL
  SELECT it + 1, s.partition, ep, CASE WHEN s.frag = e.fb THEN e.fa ELSE s.frag END, s.free AND s.ep <> e.a AND s.ep <> e.b, e.a, e.b, e.w
  FROM {name}_s s JOIN (SELECT partition, unnest(best) FROM (
    SELECT e.partition, arg_min(struct_pack(a := e.a, b := e.b, w := e.w, fa := x.frag, fb := y.frag), (-e.w, e.a, e.b)) AS best
    FROM {edges} e JOIN {name}_s x ON e.a = x.ep AND e.partition = x.partition JOIN {name}_s y ON e.b = y.ep AND e.partition = y.partition WHERE x.free AND y.free AND x.frag <> y.frag GROUP BY e.partition)) e USING (partition)),
{name} AS MATERIALIZED (SELECT DISTINCT partition, a, b, w FROM {name}_s WHERE a IS NOT NULL)"""


SQL_PAIRS_ONCE = SQL_PAIRS.replace("pairs AS (", "pairs AS MATERIALIZED (", 1)
SQL_TWO_PHASE = f"""WITH RECURSIVE {SQL_PAIRS_ONCE}, {SQL_MEMBERS}, {sql_candidates("se", "sim", 20)}, {sql_candidates("ce", "cov", 20)}, {sql_cover("sc", "se")}, {sql_cover("cc", "ce")},
both_ AS MATERIALIZED (SELECT partition, a, b, max(w) AS w FROM (SELECT partition, a, b, w + 100000.0 AS w FROM sc UNION ALL SELECT partition, a, b, w FROM cc) GROUP BY ALL), {sql_cover("links", "both_")}"""


@query("greedy_path_cover", f"WITH RECURSIVE {SQL_PAIRS_ONCE}, {SQL_MEMBERS}, {sql_candidates('e5', 'sim', 5)}, {sql_cover('cover5', 'e5')} SELECT partition, a, b, w FROM cover5")
def greedy_path_cover(spark, d):
    p, m = pairs(spark, d).withColumn("w", F.round("sim", 5)), members(spark, d)
    return linking.greedy_path_cover(materialize(linking.candidate_edges(p, m, 5), "edges"), m.select("partition", "contig"))


@query("two_phase_links", f"{SQL_TWO_PHASE} SELECT partition, a, b, w FROM links")
def two_phase_links(spark, d):
    return _links(spark, d)[2]


#: Every path is walked from both of its free ends; the lesser end's walk counts.
SQL_CHAINS = f"""{SQL_TWO_PHASE},
ends AS MATERIALIZED (SELECT partition, contig, ord, side, contig || '_' || side AS v, contig || '_' || (3 - side) AS other FROM members, (SELECT unnest([1, 2]) AS side)),
ext AS MATERIALIZED (SELECT a AS v, b AS u, w FROM links UNION ALL SELECT b, a, w FROM links),
walk(start, pos, v) AS (
  SELECT v, 0::BIGINT, v FROM ends WHERE v NOT IN (SELECT v FROM ext)
  UNION ALL
  SELECT start, pos + 1, CASE WHEN pos % 2 = 0 THEN e.other ELSE x.u END FROM walk JOIN ends e ON e.v = walk.v LEFT JOIN ext x ON x.v = walk.v WHERE pos % 2 = 0 OR x.u IS NOT NULL),
last AS (SELECT start, max(pos) AS n, arg_max(v, pos) AS stop FROM walk GROUP BY start),
chosen AS (SELECT l.start FROM last l JOIN ends s ON s.v = l.start JOIN ends t ON t.v = l.stop WHERE (s.ord, s.side) <= (t.ord, t.side)),
held AS MATERIALIZED (SELECT w.start, w.pos, e.partition, e.contig, e.side, e.v, e.ord, x.w FROM walk w JOIN chosen USING (start) JOIN ends e ON e.v = w.v LEFT JOIN ext x ON x.v = w.v),
numbers AS (SELECT start, row_number() OVER (PARTITION BY partition ORDER BY least_) AS chain_no FROM (SELECT start, any_value(partition) AS partition, min((ord, side)) AS least_ FROM held GROUP BY start))
SELECT partition, chain_no, pos, contig, side, v AS endpoint, CASE WHEN pos % 2 = 0 THEN 100000.0 ELSE w END AS w_next FROM held JOIN numbers USING (start)"""


@query("linked_chains", SQL_CHAINS)
def linked_chains(spark, d):
    return linking.chains(materialize(_links(spark, d)[2], "links"), members(spark, d))


#: Walks of orders by customer: their prices fall and rise, every fifth step is internal.
SQL_STEPS = "steps AS (SELECT o_custkey AS chain, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos, o_totalprice AS w, o_orderkey % 5 = 0 AS internal FROM orders)"


@query(
    "chain_split",
    f"""WITH RECURSIVE {SQL_STEPS}, r(chain, pos, prev, piece) AS (
  SELECT chain, pos, CASE WHEN internal THEN NULL ELSE w END, 0 FROM steps WHERE pos = 0
  UNION ALL
  SELECT s.chain, s.pos, CASE WHEN s.internal OR (r.prev > 0 AND s.w < r.prev * 0.3) THEN NULL ELSE s.w END, r.piece + CASE WHEN NOT s.internal AND r.prev > 0 AND s.w < r.prev * 0.3 THEN 1 ELSE 0 END
  FROM r JOIN steps s ON s.chain = r.chain AND s.pos = r.pos + 1)
SELECT chain, pos, piece::BIGINT AS piece FROM r""",
)
def chain_split(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    steps = table(spark, d, "orders").select(F.col("o_custkey").alias("chain"), place.cast("long").alias("pos"), F.col("o_totalprice").alias("w"), (F.col("o_orderkey") % 5 == 0).alias("internal"))
    return linking.split_on_drop(steps).select("chain", "pos", "piece")


# ------------------------------------------------------------------ sequences


@query(
    "gap_prediction",
    """SELECT o_orderkey, round(CASE WHEN o_totalprice > 1000 THEN greatest(1.0, least(100.0, pow(pow(10.0, 2.8475) / (o_totalprice / 500), 1 / 0.379))) ELSE 100.0 END, 6) AS gap,
  greatest(1, round_even(CASE WHEN o_totalprice > 1000 THEN greatest(1.0, least(100.0, pow(pow(10.0, 2.8475) / (o_totalprice / 500), 1 / 0.379))) ELSE 100.0 END, 0)::INT) AS n_bases FROM orders""",
)
def gap_prediction(spark, d):
    w = F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice") / 500).otherwise(F.lit(0.0))
    return table(spark, d, "orders").select("o_orderkey", F.round(sq.gap(w, 0.379, 2.8475), 6).alias("gap"), sq.gap_length(w, 0.379, 2.8475).alias("n_bases"))


def records(spark, d):
    """Documents as sequence records, a line of text as a line of sequence."""
    seq = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.concat(F.lit("doc_contig_"), F.col("doc_id").cast("string")).alias("name"), seq.alias("seq"))


@query("fasta_lengths", "SELECT 'doc_contig_' || doc_id AS name, length(replace(coalesce(text, ''), chr(10), '')) AS length FROM documents")
def fasta_lengths(spark, d):
    return records(spark, d).select("name", F.length("seq").cast("long").alias("length"))


@query("sequence_stats", "SELECT count(*) AS n, sum(k)::BIGINT AS total, min(k) AS least, max(k) AS most, round(avg(k), 6) AS mean FROM (SELECT length(replace(coalesce(text, ''), chr(10), '')) AS k FROM documents)")
def sequence_stats(spark, d):
    k = fasta_lengths(spark, d)
    return k.agg(F.count("*").alias("n"), F.sum("length").alias("total"), F.min("length").alias("least"), F.max("length").alias("most"), F.round(F.avg("length"), 6).alias("mean"))


@query(
    "reverse_complement",
    "SELECT doc_id, reverse(translate(regexp_replace(upper(replace(replace(coalesce(text, ''), chr(10), ''), 'ß', 'ss')), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) AS seq FROM documents",
)
def reverse_complement(spark, d):
    """Rows of 500 bases are turned one by one."""
    rows = materialize(chunks.chunked(records(spark, d).select(F.col("row_id").alias("name"), F.upper("seq").alias("seq")), 500), "bases")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("at", "bases"))), lambda x: x["bases"])
    return chunks.turned(rows).groupBy(F.col("name").alias("doc_id")).agg(F.array_join(parts, "").alias("seq"))


@query("rename_upper", "SELECT 'chr1_contig_' || row_number() OVER (ORDER BY doc_id) AS name, upper(replace(replace(coalesce(text, ''), chr(10), ''), 'ß', 'ss')) AS seq FROM documents")
def rename_upper(spark, d):
    order = numbered(records(spark, d).select("row_id"), [F.col("row_id")], "no")
    named = records(spark, d).join(order, "row_id")
    return named.select(F.concat(F.lit("chr1_contig_"), F.col("no").cast("string")).alias("name"), F.upper("seq").alias("seq"))


@query("wrap_80", r"SELECT doc_id, rtrim(regexp_replace(replace(coalesce(text, ''), chr(10), ''), '(.{80})', '\1' || chr(10), 'g'), chr(10)) AS wrapped FROM documents")
def wrap_80(spark, d):
    return records(spark, d).select(F.col("row_id").alias("doc_id"), sq.wrap(F.col("seq")).alias("wrapped"))


#: Orders as chains of their line items' suppliers, each supplier once, with the phone book
#: of suppliers as sequences.
SQL_PIECES = """lines AS (SELECT l_orderkey AS chain, l_suppkey AS number, min(l_linenumber) AS line, bool_and(l_returnflag <> 'R') AS forward FROM lineitem GROUP BY 1, 2),
pieces AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY line, number) - 1 AS piece, lag(number) OVER (PARTITION BY chain ORDER BY line, number) AS before FROM lines),
ws AS (SELECT least(x.l_suppkey, y.l_suppkey) AS lo, greatest(x.l_suppkey, y.l_suppkey) AS hi, max(x.l_quantity + y.l_quantity) AS w FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey WHERE x.l_returnflag = 'A' AND y.l_returnflag = 'A' GROUP BY ALL),
gapped AS (SELECT p.*, CASE WHEN before IS NULL THEN 0 ELSE greatest(1, round_even(CASE WHEN w > 0 THEN greatest(1.0, least(100.0, pow(pow(10.0, 2.8475) / w, 1 / 1.5))) ELSE 100.0 END, 0)::INT) END AS gap
  FROM pieces p LEFT JOIN ws ON lo = least(number, before) AND hi = greatest(number, before) AND before IS NOT NULL)"""


@query(
    "scaffold_assembly",
    f"""WITH {SQL_PIECES}, parts AS (SELECT chain, piece, repeat('N', gap) || CASE WHEN forward THEN upper(s_name) ELSE reverse(translate(regexp_replace(upper(s_name), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) END AS part
  FROM gapped JOIN supplier ON number = s_suppkey)
SELECT chain, count(*) AS n_contigs, string_agg(part, '' ORDER BY piece) AS seq FROM parts GROUP BY chain""",
)
def scaffold_assembly(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chain"), F.col("l_suppkey").alias("number"), "l_linenumber", "l_returnflag", "l_quantity")
    turns = items.select("chain", "number", "l_linenumber", (F.col("l_returnflag") != "R").alias("ahead"))
    own = items.filter("l_returnflag = 'A'").select("chain", "number", "l_quantity").repartition("chain")
    one, other = (own.select("chain", F.col("number").alias(n), F.col("l_quantity").alias(f"q_{n}")) for n in ("a", "b"))
    weights = one.join(other, "chain").filter("a < b").select("a", "b", (F.col("q_a") + F.col("q_b")).alias("weight"))
    pieces = scaffold.gaps(scaffold.pair_lookup(hubs.gathered(turns, "chain", _supplier_pieces), weights), 1.5, 2.8475)
    seqs = table(spark, d, "supplier").select(F.concat(F.lit("s_contig_"), F.col("s_suppkey").cast("string")).alias("name"), F.upper("s_name").alias("seq"))
    return scaffold.assemble(pieces, seqs)


def _supplier_pieces(turns, together):
    """Pieces of orders as chains of their suppliers, of which each is two ends in the order that its direction asks for."""
    lines = turns.groupBy("chain", "number").agg(F.min("l_linenumber").alias("line"), F.bool_and("ahead").alias("forward"))
    if together:
        lines = lines.withColumn("nth", F.row_number().over(Window.partitionBy("chain").orderBy("line", "number")))
    else:
        lines = running(lines, ["chain"], ["line", "number"], rank="nth")
    ends = F.array(F.when(F.col("forward"), 1).otherwise(2), F.when(F.col("forward"), 2).otherwise(1))
    steps = lines.select("chain", F.posexplode(ends).alias("k", "side"), "nth", "number")
    name = F.concat(F.lit("s_contig_"), F.col("number").cast("string"))
    chain_ends = steps.select("chain", (2 * (F.col("nth") - 1) + F.col("k")).alias("pos"), F.concat_ws("_", name, F.col("side").cast("string")).alias("endpoint"))
    return scaffold.pieces_in_order(chain_ends, together)


@query("unplaced_contigs", "SELECT p_name AS name, p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)")
def unplaced_contigs(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"), "p_name", "p_partkey")
    used = table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").cast("string").alias("contig"))
    return scaffold.unplaced(parts, used).select(F.col("p_name").alias("name"), "p_partkey")


# ------------------------------------------------------------------ text forms


@query(
    "merged_text",
    f"""WITH {SQL_ALN}, {SQL_MERGED}, r AS (SELECT read, string_agg(contig || ',0,' || length || ',' || strand || ',' || t_start || ',' || t_end || ',' || length, chr(10) ORDER BY first, contig) AS body
  FROM (SELECT m.* FROM merged m) GROUP BY read), h AS (SELECT DISTINCT read FROM aln WHERE mapq >= 30)
SELECT h.read, h.read || ':' || coalesce(chr(10) || body, '') AS value FROM h LEFT JOIN r USING (read)""",
)
def merged_text(spark, d):
    """The merged length stands for the query's end too: several first rows may share one. Reads of low quality only have no header."""
    return merged_blocks(al.quality_filter(alignments(spark, d), 30)).select("read", "value")


def merged_blocks(good: DataFrame) -> DataFrame:
    """(read, seen, value): the block of every read of ``good``, made where its rows lie."""

    def step(rows, together):
        whole = al.merge(rows, min_length=None).withColumn("q_end", F.col("length")).withColumn("first", F.struct("first", "contig"))
        return interchange.merged_blocks(whole, al.MIN_MERGED)

    # Written, as the sort that follows reads its rows twice, to find ranges and to deal them.
    return materialize(hubs.gathered(good.select("read", "contig", "q_start", "q_end", "strand", "t_start", "t_end", "length", "row_id"), "read", step), "merged-blocks")


@query(
    "extracted_text",
    f"""WITH {SQL_ALN}, good AS (SELECT * FROM aln WHERE q_end >= 100 AND mapq >= 60)
SELECT read, read || ':' || chr(10) || string_agg(contig || ',' || t_len || ',' || t_start || ',' || t_end || ',' || mapq, chr(10) ORDER BY {', '.join(ORDER)}) || chr(10) AS value FROM good GROUP BY read HAVING count(*) >= 2""",
)
def extracted_text(spark, d):
    rows = al.extract(alignments(spark, d)).withColumn("read", F.col("read").cast("string"))
    return interchange.extracted_lines(rows).select(F.col("read").cast("long").alias("read"), "value")


#: Every tenth contig's name ends without a number.
SQL_LINES = f"{SQL_KEPT}, lines AS (SELECT read, string_agg(CASE WHEN vertex % 10 = 0 THEN 'X' ELSE '' END || vertex || ' ' || weight, ' ' ORDER BY first, vertex) AS value FROM kept GROUP BY read)"


def hyper_lines(spark, d):
    odd = F.regexp_replace("contig", "_([0-9]*0)$", "_X$1")
    rows = hypergraph.labelled(kept_entries(spark, d).withColumn("contig", odd))
    number = F.regexp_replace("vertex", "X", "").cast("long")
    return interchange.hyperedge_lines(rows.withColumn("pos", F.struct("pos", number)))


@query("hyperedges_rejected", f"WITH {SQL_LINES} SELECT DISTINCT read, 'number' AS reason FROM kept WHERE vertex % 10 = 0")
def hyperedges_rejected(spark, d):
    """Lines with a name that is no number."""
    lines = hyper_lines(spark, d).select(F.col("read").alias("row_id"), "value")
    return rejected(interchange.scan_hyperedges(lines)).select(F.col("row_id").alias("read"), "reason")


@query(
    "hyperedges_of_numbers",
    f"WITH {SQL_KEPT} SELECT read AS edge_id, vertex, weight::DOUBLE AS weight FROM kept WHERE read NOT IN (SELECT read FROM kept WHERE vertex % 10 = 0)",
)
def hyperedges_of_numbers(spark, d):
    """The same without text: a read with a contig that has no number is no hyperedge."""
    odd = F.regexp_replace("contig", "_([0-9]*0)$", "_X$1")
    return hypergraph.to_hyperedges(kept_entries(spark, d).withColumn("contig", odd)).select("edge_id", "vertex", "weight")


@query("hyperedge_text", f"WITH {SQL_LINES} SELECT read, value FROM lines")
def hyperedge_text(spark, d):
    return hyper_lines(spark, d)


@query(
    "hyperedge_parse",
    f"WITH {SQL_LINES} SELECT read AS edge_id, vertex, weight::DOUBLE AS weight, row_number() OVER (PARTITION BY read ORDER BY first, vertex) - 1 AS pos FROM kept WHERE read NOT IN (SELECT read FROM kept WHERE vertex % 10 = 0)",
)
def hyperedge_parse(spark, d):
    """A line with a name that is no number is left out whole."""
    lines = hyper_lines(spark, d).select(F.col("read").alias("row_id"), "value")
    return interchange.parse_hyperedges(lines).withColumn("pos", F.col("pos").cast("long"))


@query("community_text", "SELECT s_nationkey AS label, s_nationkey || ': ' || string_agg(s_suppkey::VARCHAR, ' ' ORDER BY s_suppkey) AS value FROM supplier GROUP BY 1")
def community_text(spark, d):
    return interchange.community_lines(labelled(spark, d))


@query("community_parse", "SELECT s_nationkey::VARCHAR AS partition, s_suppkey::VARCHAR AS vertex FROM supplier")
def community_parse(spark, d):
    lines = interchange.community_lines(labelled(spark, d)).select(F.col("label").alias("row_id"), "value")
    return interchange.parse_partitions(lines).select("partition", "vertex")


#: Real numbers, many of them a hair off halfway between two cents.
SQL_WEIGHTS = "w AS (SELECT l_suppkey AS a, l_partkey AS b, sum(l_quantity) / 1000 AS w, sqrt(sum(l_quantity)) AS r FROM lineitem GROUP BY 1, 2)"


def real_weights(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("a"), F.col("l_partkey").cast("string").alias("b"))
    return rows.agg((F.sum("l_quantity") / 1000).alias("w"), F.sqrt(F.sum("l_quantity")).alias("r"))


@query("weight_text", f"WITH {SQL_WEIGHTS} SELECT a::VARCHAR AS a, b::VARCHAR AS b, a || ' ' || b || ' ' || printf('%.2f', w) AS value, a || ' ' || b || ' ' || printf('%.2f', r) AS root FROM w")
def weight_text(spark, d):
    """Thousandths, of which every tenth lies by a half between two cents, and roots."""
    rows = real_weights(spark, d)
    both = rows.select("a", "b", F.col("w").alias("weight"), "r")
    out = interchange.weight_lines(both.select("a", "b", "weight"))
    return out.join(interchange.weight_lines(both.select("a", "b", F.col("r").alias("weight"))).withColumnRenamed("value", "root"), ["a", "b"])


@query("adjacency_text", f"WITH {SQL_BOTH} SELECT v, row_number() OVER (PARTITION BY v ORDER BY weight DESC, neighbor) AS rank, v || ' ' || neighbor || ' ' || weight::VARCHAR AS value FROM arcs")
def adjacency_text(spark, d):
    return interchange.adjacency_lines(hypergraph.adjacency(graph(spark, d)))


@query("float_texts", "SELECT o_orderkey, o_custkey % 36 AS k, (o_orderkey * CASE WHEN o_custkey % 36 < 18 THEN CAST('1e' || (o_custkey % 36) AS DOUBLE) ELSE 1.0 / CAST('1e' || (o_custkey % 36 - 17) AS DOUBLE) END)::VARCHAR AS value FROM orders")
def float_texts(spark, d):
    """Whole numbers times powers of ten, exact up to 1e22: all forms that a number's text takes."""
    k = F.col("o_custkey") % 36
    up, down = (F.concat(F.lit("1e"), x.cast("string")).cast("double") for x in (k, k - 17))
    x = F.col("o_orderkey") * F.when(k < 18, up).otherwise(1.0 / down)
    return table(spark, d, "orders").select("o_orderkey", k.alias("k"), sq.float_text(x).alias("value"))


@query("chain_parse", "SELECT o_custkey || '_1' AS chain, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, 'o_' || o_orderkey AS endpoint FROM orders")
def chain_parse(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("partition"), F.lit(1).alias("chain_no"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("o_"), F.col("o_orderkey").cast("string")).alias("endpoint"))
    lines = interchange.chain_lines(rows).select(F.col("partition").alias("row_id"), "value")
    return interchange.parse_chains(lines).select("chain", F.col("pos").cast("long").alias("pos"), "endpoint")


@query("length_text", "SELECT doc_id AS row_id, '>doc_contig_' || doc_id || chr(10) || length(replace(coalesce(text, ''), chr(10), '')) AS value FROM documents")
def length_text(spark, d):
    return fasta.length_lines(records(spark, d).withColumn("length", F.length("seq")))


@query(
    "scaffold_text",
    r"SELECT doc_id AS no, '>scaffold' || doc_id || chr(10) || rtrim(regexp_replace(replace(coalesce(text, ''), chr(10), ''), '(.{80})', '\1' || chr(10), 'g'), chr(10)) AS value FROM documents",
)
def scaffold_text(spark, d):
    """Through rows of 1,000 bases and blocks of ten lines; only for the comparison a text is one value again."""
    rows = chunks.blocks(chunks.chunked(records(spark, d).select(F.col("row_id").alias("name"), "seq"), 1000), 800)
    lines = fasta.block_lines(rows.withColumnRenamed("name", "no"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("block", "value"))), lambda x: x["value"])
    return lines.groupBy("no").agg(F.array_join(parts, "\n").alias("value"))


@query(
    "name_parts",
    """SELECT c_custkey, split_part(name, '_', -1) AS suffix, regexp_extract(name, '^(.*)_([^_]*)$', 1) AS stem, regexp_extract(name, '_([0-9]+)_[^0-9]*$', 1)::BIGINT AS number
FROM (SELECT c_custkey, 'c_' || c_custkey || '_' || lower(c_mktsegment) AS name FROM customer)""",
)
def name_parts(spark, d):
    name = F.concat(F.lit("c_"), F.col("c_custkey").cast("string"), F.lit("_"), F.lower("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", sq.suffix(name).alias("suffix"), sq.stem(name).alias("stem"), sq.digit_segment(name).alias("number"))


@query("mean_degree", f"WITH {SQL_BOTH} SELECT round(avg(n), 6) AS mean_degree FROM (SELECT count(*) AS n FROM arcs GROUP BY v)")
def mean_degree(spark, d):
    return hypergraph.degrees(graph(spark, d)).agg(F.round(F.avg("degree"), 6).alias("mean_degree"))


# ------------------------------------------------------------------ scans of text written from the tables


def written(lines: DataFrame, name: str, order: list) -> str:
    """The path of ``lines`` as text, sorted, in the shared folder."""
    path = new_path(lines.sparkSession, name)
    write_lines(lines, path, order)
    return path


#: Line items as PAF. Of seven lines of an order the sixth has no number for its quality and
#: the seventh lacks a column; the fifth has a length that only one of the scans reads.
def paf_path(spark, d) -> str:
    rows = alignments(spark, d)
    n = F.col("row_id.l_linenumber")
    fields = [
        F.concat(F.lit("r"), F.col("read").cast("string")), F.lit("9000"), F.col("q_start"), F.col("q_end"), F.concat("strand", F.lit("x")), "contig", F.when(n == 5, "?").otherwise(F.col("t_len").cast("string")),
        "t_start", "t_end", F.lit("1"), F.lit("2"), F.when(n == 6, "high").otherwise(F.col("mapq").cast("string")),
    ]
    line = F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in fields])
    line = F.when(n == 7, F.regexp_replace(line, "\t[^\t]*$", "")).otherwise(line)
    return written(rows.select(line.alias("value"), "read", "row_id"), "paf", ["read", "row_id"])


@query("paf_alignments", f"WITH {SQL_ALN} SELECT 'r' || read AS read, q_start, q_end, strand, contig, t_start, t_end, mapq FROM aln WHERE l_linenumber NOT IN (6, 7)")
def paf_alignments(spark, d):
    rows = paf.read_alignments(spark, paf_path(spark, d))
    return rows.select("read", F.col("q_start").cast("int").alias("q_start"), "q_end", "strand", "contig", "t_start", "t_end", "mapq")


@query(
    "paf_placements",
    f"WITH {SQL_ALN} SELECT 'r' || read AS read, q_end, contig, CASE WHEN l_linenumber = 5 THEN '?' ELSE t_len::VARCHAR END AS t_len, t_start::VARCHAR AS t_start, t_end::VARCHAR AS t_end, mapq FROM aln WHERE l_linenumber NOT IN (6, 7)",
)
def paf_placements(spark, d):
    return paf.read_placements(spark, paf_path(spark, d)).select("read", "q_end", "contig", "t_len", "t_start", "t_end", "mapq")


@query(
    "paf_rejected",
    f"WITH {SQL_ALN} SELECT 'r' || read AS read, 'merge' AS scan, CASE WHEN l_linenumber = 7 THEN 'fields' ELSE 'integers' END AS reason FROM aln WHERE l_linenumber IN (6, 7) UNION ALL SELECT 'r' || read, 'extract', CASE WHEN l_linenumber = 7 THEN 'fields' ELSE 'integers' END FROM aln WHERE l_linenumber IN (6, 7)",
)
def paf_rejected(spark, d):
    """Lines that neither scan can read, by the read that they begin with, and why."""
    path = paf_path(spark, d)
    both = [rejected(f(spark, path)).select(F.split("value", "\t")[0].alias("read"), F.lit(n).alias("scan"), "reason") for n, f in (("merge", paf.scan_alignments), ("extract", paf.scan_placements))]
    return both[0].unionByName(both[1])


#: Reads in the order of their first good line, when lines stand by number and then by read.
SQL_BY_LINE = f"{SQL_ALN}, {SQL_MERGED}, seen AS (SELECT read, row_number() OVER (ORDER BY min(({SQL_ORDER}, read))) AS place FROM aln WHERE mapq >= 30 GROUP BY read)"


@query(
    "merged_file",
    f"""WITH {SQL_BY_LINE}, r AS (SELECT read, string_agg(contig || ',0,' || length || ',' || strand || ',' || t_start || ',' || t_end || ',' || length, chr(10) ORDER BY first, contig) AS body FROM merged GROUP BY read)
SELECT place, 'r' || read || ':' || coalesce(chr(10) || body, '') AS value FROM seen LEFT JOIN r USING (read)""",
)
def merged_file(spark, d):
    """Blocks of reads in the order of their first good line in a file, with their places."""
    rows = alignments(spark, d)
    columns = [F.concat(F.lit("r"), F.col("read").cast("string")), F.lit("9"), "q_start", "q_end", "strand", "contig", "t_len", "t_start", "t_end", F.lit("1"), F.lit("2"), "mapq"]
    line = F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns])
    good = al.quality_filter(paf.read_alignments(spark, written(rows.select(line.alias("value"), "row_id", "read"), "lines", ["row_id", "read"])), 30)
    lines = merged_blocks(good)
    return numbered(lines, [F.asc("seen")], "place").select("place", "value")


@query("paf_merge", f"WITH {SQL_ALN.replace('FROM lineitem', 'FROM lineitem WHERE l_linenumber NOT IN (6, 7)')}, {SQL_MERGED} SELECT 'r' || read AS read, contig, t_start, t_end, strand, length FROM merged")
def paf_merge(spark, d):
    """The first row is the file's first: lines stand by read and row."""
    rows = paf.read_alignments(spark, paf_path(spark, d))
    return al.merge(al.quality_filter(rows, 30)).select("read", "contig", "t_start", "t_end", "strand", "length")


#: Documents as FASTA, with a description, a carriage return and the text's own lines.
SQL_RECORDS = "records AS (SELECT doc_id, replace(replace(replace(coalesce(text, ''), '>', '}'), chr(13), ''), chr(10), '') AS seq, 'doc_' || doc_id || ' ' || coalesce(lang, '?') AS header FROM documents)"


def fasta_path(spark, d, name=None) -> str:
    docs = table(spark, d, "documents")
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(">"), F.lit("}")), F.lit("\r"), F.lit(""))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string")) if name is None else name
    record = F.concat(F.lit(">"), name, F.lit(" "), F.coalesce("lang", F.lit("?")), F.lit("\r\n"), text)
    return written(docs.select(record.alias("value"), "doc_id"), "fasta", ["doc_id"])


@query("fasta_scan", f"WITH {SQL_RECORDS} SELECT 'doc_' || doc_id AS name, header, length(seq) AS length, sha256(seq) AS seq_sha256 FROM records")
def fasta_scan(spark, d):
    return fasta.read_fasta(spark, fasta_path(spark, d)).select("name", "header", "length", F.sha2("seq", 256).alias("seq_sha256"))


@query("fasta_lengths_text", f"WITH {SQL_RECORDS} SELECT '>doc_' || doc_id || chr(10) || length(seq) AS value FROM records")
def fasta_lengths_text(spark, d):
    return fasta.length_lines(fasta.records(fasta.read_fasta_chunks(spark, fasta_path(spark, d), bases=False))).select("value")


@query(
    "fasta_last_of_name",
    f"WITH {SQL_RECORDS} SELECT 'copy_' || (doc_id // 3) AS name, min(doc_id) AS first_of, arg_max(length(seq), doc_id) AS length, arg_max(sha256(seq), doc_id) AS seq_sha256 FROM records GROUP BY 1",
)
def fasta_last_of_name(spark, d):
    """Three records to a name: the first one's place and the last one's sequence."""
    name = F.concat(F.lit("copy_"), F.expr("doc_id div 3").cast("string"))
    rows = fasta.last_of_each_name(fasta.read_fasta(spark, fasta_path(spark, d, name)))
    least = table(spark, d, "documents").groupBy(name.alias("name")).agg(F.min("doc_id").alias("first_of"))
    placed = numbered(rows.select("row_id", "name"), [F.asc("row_id")], "place").join(numbered(least, [F.asc("first_of")], "place").withColumnRenamed("name", "by_id"), "place")
    return rows.join(placed.select("name", "by_id", "first_of"), "name").filter("name = by_id").select("name", "first_of", "length", F.sha2("seq", 256).alias("seq_sha256"))


@query("fasta_renamed", f"WITH {SQL_RECORDS} SELECT 'chr1_contig_' || row_number() OVER (ORDER BY doc_id) AS name, sha256(upper(replace(seq, 'ß', 'ss'))) AS seq_sha256 FROM records")
def fasta_renamed(spark, d):
    return fasta.renamed(fasta.read_fasta(spark, fasta_path(spark, d))).select("name", F.sha2("seq", 256).alias("seq_sha256"))


@query("merged_scan", f"WITH {SQL_ALN}, {SQL_MERGED} SELECT read::VARCHAR AS read, contig, strand, t_start::DOUBLE AS t_start, t_end::DOUBLE AS t_end, length::DOUBLE AS length FROM merged")
def merged_scan(spark, d):
    path = written(merged_text(spark, d), "merged", ["read"])
    return interchange.read_merged(spark, path).select("read", "contig", "strand", "t_start", "t_end", "length")


@query(
    "extracted_scan",
    f"WITH {SQL_ALN}, good AS (SELECT * FROM aln WHERE q_end >= 100 AND mapq >= 60) SELECT read::VARCHAR AS read, contig, t_len, t_start, t_end FROM good WHERE read IN (SELECT read FROM good GROUP BY read HAVING count(*) >= 2)",
)
def extracted_scan(spark, d):
    path = written(extracted_text(spark, d), "extracted", ["read"])
    return interchange.read_extracted(spark, path).select("read", "contig", "t_len", "t_start", "t_end")


@query("weight_scan", f"WITH {SQL_WEIGHTS}, t AS (SELECT a, b, printf('%.2f', w)::DOUBLE AS weight FROM w) SELECT a, b, weight FROM t WHERE weight > 0")
def weight_scan(spark, d):
    """What is written as 0.00 is not read."""
    lines = interchange.weight_lines(real_weights(spark, d).withColumnRenamed("w", "weight"))
    return interchange.read_weights(spark, written(lines, "weights", ["a", "b"])).select("a", "b", "weight")
