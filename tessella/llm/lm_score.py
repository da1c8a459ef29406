"""Cross-entropy difference of matched target and background models: what the query asks for.

The models and the scoring are in ``word_model``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import word_model


def lm_score_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The target is what is labelled good and not toxic; the background is all documents."""
    good = labels.groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    # Labels grow with the documents: a plain shuffle at every size, no broadcast at small ones.
    good = good.withColumnRenamed("doc_id", "d").hint("merge")
    marked = documents.select("doc_id", "text").join(good, F.col("doc_id") == F.col("d"), "left").drop("d")
    return word_model.score(marked, F.col("good"))


ORACLE = rf"""
WITH good AS (SELECT doc_id, bool_and(quality = 1 AND toxic = 0) AS good FROM labels GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(good, false) AS target,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x{{3000}}-\x{{9FFF}}]|[0-9a-z\x{{80}}-\x{{2FFF}}\x{{A000}}-\x{{10FFFF}}]+|[!-~]') AS w
  FROM documents LEFT JOIN good USING (doc_id)),
t AS MATERIALIZED (SELECT r, target, i, y, coalesce(lag(y) OVER (PARTITION BY r ORDER BY i), '') AS x FROM (SELECT r, target, generate_subscripts(s, 1) AS i, unnest(s) AS y FROM (SELECT r, target, list_append(w, '') AS s FROM d WHERE len(w) > 0))),
one AS (SELECT y, count(*) AS n, count(*) FILTER (target) AS g FROM t GROUP BY 1),
two AS (SELECT x, y, count(*) AS n, count(*) FILTER (target) AS g FROM t GROUP BY 1, 2),
mine AS (SELECT r, y, count(*) AS n FROM t GROUP BY 1, 2),
pairs AS (SELECT r, x, y, count(*) AS n FROM t GROUP BY 1, 2, 3),
own AS (SELECT r, count(*) AS n FROM t GROUP BY 1),
total AS (SELECT count(*) AS n, count(*) FILTER (target) AS g, count(DISTINCT y) AS v FROM t),
c AS (SELECT t.r, one.n - mine.n AS n1, one.g - mine.n * t.target::INT AS g1, two.n - pairs.n AS n2, two.g - pairs.n * t.target::INT AS g2,
  b.n - bm.n AS nb, b.g - bm.n * t.target::INT AS gb, total.n - own.n AS n, total.g - own.n * t.target::INT AS g, v
  FROM t JOIN one USING (y) JOIN two ON two.x = t.x AND two.y = t.y JOIN one b ON b.y = t.x JOIN mine ON mine.r = t.r AND mine.y = t.y JOIN mine bm ON bm.r = t.r AND bm.y = t.x
  JOIN pairs ON pairs.r = t.r AND pairs.x = t.x AND pairs.y = t.y JOIN own ON own.r = t.r, total),
l AS (SELECT r, avg(-ln((g2 + {word_model.RESERVE} * (g1 + 1) / (g + v)) / (gb + {word_model.RESERVE}))) AS target_loss,
  avg(-ln((n2 + {word_model.RESERVE} * (n1 + 1) / (n + v)) / (nb + {word_model.RESERVE}))) AS background_loss FROM c GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_tokens, round(coalesce(target_loss, 0), 6) AS target_loss, round(coalesce(background_loss, 0), 6) AS background_loss,
  round(coalesce(target_loss - background_loss, 0), 6) AS score
FROM d LEFT JOIN l USING (r)"""
