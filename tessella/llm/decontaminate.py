"""Benchmark decontamination by winnowing. DataFrame and SQL functions only.

Of every run of W consecutive K-word hashes the least is kept, on both sides, so any shared
span of K + W - 1 = 13 words shares a fingerprint. Fingerprints are joined; around each
shared one the hit is extended to every 13-word window over it, and windows are compared
word for word. Items shorter than a window are one window each; for them documents also
show all their hashes of the item's length, K words at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.text import NOT_ALNUM, ascii_lower, let, whole, words
from tessella.plans.materialize import materialize

WINDOW, K = 13, 5
#: Bytes of hashes or of windows' texts up to which a benchmark's side is broadcast; a larger
#: one is joined by a shuffle. They are summed first.
BROADCAST_BYTES = 1 << 25


def item_words(text: Column) -> Column:
    return words(ascii_lower(whole(text)), NOT_ALNUM)


def hashes(w: Column, k: int) -> Column:
    none = F.array().cast("array<bigint>")
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) >= k, grams).otherwise(none)


def minima(h: Column, run: int) -> Column:
    """The least of every ``run`` consecutive hashes, each once; of a shorter list the least."""
    last = F.greatest(F.size(h) - run, F.lit(0))
    least = F.transform(F.sequence(F.lit(0), last), lambda i: F.least(*[F.get(h, i + j) for j in range(run)]))
    return F.when(F.size(h) > 0, F.array_distinct(least)).otherwise(h)


def _small(df: DataFrame) -> DataFrame:
    """``df``, which is written, broadcast if it is small."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(8) for c, t in df.dtypes), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def _span(positions: Column, w: Column, back: int, length: int) -> Column:
    """Starts of the windows of ``length`` words that lie over a seed up to ``back`` words in."""
    last = F.size(w) - length

    def of(p: Column) -> Column:
        lo, hi = F.greatest(p - back, F.lit(0)), F.least(p, last)
        return F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.flatten(F.transform(positions, of)))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in any occurrence of a benchmark window; contaminated means
    that a twentieth of the words or more are hit. Null and empty texts have no words, no
    hits, and are clean; items without words match nothing; items that share an id count
    once and a null id counts as none; repeated rows each get their row. Other columns are
    not read.
    """
    items = benchmark.select(F.col(item).cast("string").alias("item"), item_words(F.col(item_text)).alias("w")).filter(F.size("w") > 0)
    items = materialize(items.withColumn("n", F.least(F.size("w"), F.lit(WINDOW))), "items")
    # At most WINDOW - 1 lengths.
    short = sorted(r[0] for r in items.filter(F.col("n") < WINDOW).select("n").distinct().collect())
    dense = sorted({min(n, K) for n in short})

    def prints(w: Column) -> Column:
        if K in dense:
            main = F.array_distinct(hashes(w, K))
        else:
            main = let(hashes(w, K), lambda h: minima(h, WINDOW - K + 1))
        return F.concat(main, *[F.array_distinct(hashes(w, k)) for k in dense if k < K]) if any(k < K for k in dense) else main

    of_item = F.when(F.col("n") == WINDOW, let(hashes(F.col("w"), K), lambda h: minima(h, WINDOW - K + 1)))
    for n in short:
        of_item = of_item.when(F.col("n") == n, F.array(F.array_min(hashes(F.col("w"), min(n, K)))))
    known = materialize(items.select(F.explode(of_item).alias("h")).distinct(), "known")
    small = _small(known)

    scanned = docs.select(F.col(key).alias("doc"), item_words(F.col(text)).alias("w"))
    scanned = materialize(scanned.select("doc", F.size("w").cast("long").alias("n_words"), prints(F.col("w")).alias("prints")), "prints")
    shared = scanned.select("doc", F.explode("prints").alias("h")).join(small, "h")
    seeds = materialize(shared.select("doc").distinct(), "seeds")

    near = docs.select(F.col(key).alias("doc"), F.col(text).alias("t")).join(seeds.withColumnRenamed("doc", "d"), F.col("doc").eqNullSafe(F.col("d")))
    near = near.select(F.monotonically_increasing_id().alias("row"), "doc", item_words(F.col("t")).alias("w"))
    near = materialize(near, "near")
    w = F.col("w")
    # Places of known hashes, looked up by a join and not word by seed.
    placed = near.select("row", "w")
    for k in sorted({K, *dense}):
        at = near.select("row", F.posexplode(hashes(w, k)).alias("i", "h")).join(small, "h").groupBy("row").agg(F.collect_list("i").alias(f"p{k}"))
        placed = placed.join(at, "row", "left").withColumn(f"p{k}", F.coalesce(f"p{k}", F.array().cast("array<int>")))
    # Each length's starts stand in a column of their own, computed once per document.
    lengths = [*short, WINDOW]
    starts = placed.select("row", "w", *[_span(F.col(f"p{min(n, K)}"), w, n - min(n, K), n).alias(f"s{n}") for n in lengths])

    def texts(n: int) -> Column:
        return F.transform(F.col(f"s{n}"), lambda s: F.struct(s.alias("s"), F.lit(n).alias("n"), F.array_join(F.slice(w, s + 1, n), " ").alias("win")))

    wins = F.flatten(F.array(*[texts(n) for n in lengths]))
    wins = starts.select("row", F.explode(wins).alias("x")).select("row", "x.*")

    windows = items.select("item", "n", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("s"))
    windows = windows.select("item", F.array_join(F.slice(F.col("w"), F.col("s") + 1, F.col("n")), " ").alias("win")).distinct()
    windows = materialize(windows, "windows")
    held = materialize(windows.groupBy("win").agg(F.count("*").alias("holders")), "held")
    hits = materialize(wins.join(_small(held).drop("holders"), "win"), "hits")

    def longer(acc: Column, x: Column) -> Column:
        end = x["s"] + x["n"]
        more = F.greatest(end - F.greatest(acc["end"], x["s"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["hit"] + more).alias("hit"))

    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))
    covered = F.aggregate(F.sort_array(F.collect_list(F.struct("s", "n"))), start, longer)["hit"].cast("long")
    hit = hits.groupBy("row").agg(covered.alias("n_hit"))
    # Items are listed once for all documents with the same windows in them: a prompt that
    # many items and many documents share is one list, not a row for each two.
    found = hits.groupBy("row").agg(F.sort_array(F.collect_set("win")).alias("wins")).withColumn("kind", F.sha2(F.array_join("wins", "\n"), 256))
    found = materialize(found, "found")
    kinds = found.groupBy("kind").agg(F.min("wins").alias("wins")).select("kind", F.explode("wins").alias("win"))
    listed = kinds.join(_small(windows.filter("item is not null")), "win").groupBy("kind").agg(F.sort_array(F.collect_set("item")).alias("items"))
    listed = listed.select("kind", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    listed = found.select("row", "kind").join(materialize(listed, "listed"), "kind").drop("kind")

    none, nothing = F.lit(0).cast("long"), F.sha2(F.lit(""), 256)
    judged = near.select("row", "doc", F.size("w").cast("long").alias("n_words")).join(hit, "row", "left").join(listed, "row", "left")
    judged = judged.select("doc", "n_words", *[F.coalesce(c, x).alias(c) for c, x in (("n_hit", none), ("n_items", none), ("items_sha256", nothing))])
    clean = scanned.join(seeds.select(F.col("doc").alias("d")), F.col("doc").eqNullSafe(F.col("d")), "left_anti")
    clean = clean.select("doc", "n_words", none.alias("n_hit"), none.alias("n_items"), nothing.alias("items_sha256"))
    out = judged.unionByName(clean)
    return out.select(
        F.col("doc").alias(key),
        "n_words",
        "n_hit",
        "n_items",
        "items_sha256",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose key has no contaminated row, all columns as they are."""
    bad = contamination(docs, benchmark, key, text).filter("contaminated").select(F.col(key).alias("__bad")).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad["__bad"]), "left_anti")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM (SELECT item, n, w, unnest(generate_series(1, len(w) - n + 1)) AS s FROM bn)),
ln AS (SELECT DISTINCT n FROM bn),
dw AS (SELECT r, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, ln WHERE len(w) >= n)),
h AS MATERIALIZED (SELECT r, s, n, win FROM dw WHERE win IN (SELECT win FROM bw)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM h) GROUP BY r),
i AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM h JOIN bw USING (win) WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)"""
