"""Weakly supervised quality rules.

Every rule votes that a document is good, votes that it is bad, or abstains. An
expectation-maximisation over the counts of vote patterns estimates, with nothing labelled,
how often each rule is right about good and about bad documents and how many are good; the
posterior probability of "good" replaces a filter that all rules must pass. Rules overlap, so
that one doubtful vote is outweighed by the others and several weak ones add up. DataFrame
and SQL functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.features import BROKEN, ENDS, LATIN, MARKS, VOWELS, text_counts
from tessella.llm.text import let
from tessella.plans.materialize import materialize


@dataclass(frozen=True)
class Rule:
    """Two SQL conditions on the counts of a document; neither true: the rule abstains."""

    name: str
    good: str
    bad: str


#: Integer conditions, so that every engine agrees on each vote. Bounds are eager: single
#: rules may well be wrong about a document.
RULES = (
    Rule("length", "n_words >= 30", "n_words < 20"),
    Rule("symbols", "n_words >= 10 AND 200 * n_symbols <= word_chars", "100 * n_symbols > 4 * word_chars"),
    Rule("marks", "n_words >= 10 AND 50 * n_marks <= n_words", "5 * n_marks > n_words"),
    Rule("letters", "n_words >= 10 AND 10 * n_letters >= 9 * word_chars", "5 * n_letters < 4 * word_chars"),
    Rule("dup_lines", "n_lines >= 4 AND n_dup_lines = 0", "n_lines >= 3 AND 4 * n_dup_lines > n_lines"),
    Rule("repeats", "n_words >= 20 AND 50 * n_repeat_words <= n_words", "100 * n_repeat_words > 10 * n_words"),
    Rule("word_length", "n_words >= 10 AND word_chars >= 3 * n_words AND word_chars <= 10 * n_words", "word_chars < 3 * n_words OR word_chars > 12 * n_words"),
    Rule("shouting", "n_letters >= 40 AND 100 * n_upper <= 12 * n_letters", "100 * n_upper > 20 * n_letters"),
    # Distinct words grow with the root of a text's length or faster, so one bound holds at any length.
    Rule("variety", "n_words >= 50 AND n_distinct * n_distinct >= 16 * n_words", "n_words >= 50 AND n_distinct * n_distinct < 6 * n_words"),
    Rule("sentences", "n_words >= 10 AND 50 * n_ends >= n_words AND 4 * n_ends <= n_words", "n_words >= 20 AND (60 * n_ends < n_words OR 3 * n_ends > n_words)"),
    Rule("flow", "n_ends >= 2 AND 10 * n_broken <= n_ends", "n_ends >= 1 AND 5 * n_broken > n_ends"),
    Rule("vowels", "n_latin >= 40 AND 4 * n_vowels >= n_latin AND 5 * n_vowels <= 3 * n_latin", "n_latin >= 40 AND 2 * n_latin >= n_letters AND 6 * n_vowels < n_latin"),
)
#: Votes that each accuracy starts from, right ones and all; iterations; documents stay whose
#: posterior is over KEEP_OVER. A vote for bad weighs BAD_WEIGHT votes for good at the start only.
RIGHT, VOTES, ROUNDS, KEEP_OVER, BAD_WEIGHT = 4.0, 5.0, 40, 0.5, 6


def vote(rule: Rule) -> Column:
    return F.when(F.expr(rule.bad), 0).when(F.expr(rule.good), 2).otherwise(1)


def pattern(rules: tuple[Rule, ...]) -> Column:
    """All votes as one number to the base 3: 0 bad, 1 abstains, 2 good."""
    code = F.lit(0)
    for r in rules:
        code = code * 3 + vote(r)
    return code.cast("int")


def _posterior(votes: Column, model: Column, m: int) -> Column:
    """P(good) of one vote array, given the model: accuracies on good and on bad, and the balance."""

    def odds(acc: Column, i: Column) -> Column:
        v, on_good, on_bad = F.get(votes, i), F.get(model["on_good"], i), F.get(model["on_bad"], i)
        return acc + F.when(v == 2, F.log(on_good) - F.log(1 - on_bad)).when(v == 0, F.log(1 - on_good) - F.log(on_bad)).otherwise(F.lit(0.0))

    start = F.log(model["balance"]) - F.log(1 - model["balance"])
    return 1 / (1 + F.exp(-F.aggregate(F.sequence(F.lit(0), F.lit(m - 1)), start, odds)))


def _model(table: Column, m: int) -> Column:
    """M step: per rule, the expected share of right votes on good and on bad documents; the share of good ones."""

    def share(i: Column, right: int, weight) -> Column:
        def total(wanted) -> Column:
            return F.aggregate(table, F.lit(0.0), lambda a, r: a + F.when(wanted(F.get(r["votes"], i)), r["n"] * weight(r["p"])).otherwise(F.lit(0.0)))

        return (RIGHT + total(lambda v: v == right)) / (VOTES + total(lambda v: v != 1))

    rules = F.sequence(F.lit(0), F.lit(m - 1))
    n = F.aggregate(table, F.lit(0.0), lambda a, r: a + r["n"])
    good = F.aggregate(table, F.lit(0.0), lambda a, r: a + r["n"] * r["p"])
    return F.struct(
        F.transform(rules, lambda i: share(i, 2, lambda p: p)).alias("on_good"), F.transform(rules, lambda i: share(i, 0, lambda p: 1 - p)).alias("on_bad"), ((1 + good) / (2 + n)).alias("balance")
    )


def fit(patterns: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, p_good, on_good, on_bad, balance) from (pattern, n).

    There are at most 3 ** len(rules) patterns whatever the corpus, so the iterations run
    as one expression over one array of at most that many entries. It starts from the
    balance of the votes, a vote for bad weighing as BAD_WEIGHT for good.
    """
    m = len(rules)
    votes = F.array(*[F.pmod(F.floor(F.col("pattern") / 3 ** (m - 1 - i)), F.lit(3)).cast("int") for i in range(m)])
    rows = patterns.select("pattern", F.col("n").cast("double").alias("n"), votes.alias("votes"))
    good, bad = F.size(F.filter("votes", lambda v: v == 2)), F.size(F.filter("votes", lambda v: v == 0))
    rows = rows.withColumn("p", (1.0 + good) / (2.0 + good + BAD_WEIGHT * bad))
    one = rows.agg(F.sort_array(F.collect_list(F.struct("pattern", "n", "votes", "p"))).alias("t"))

    def step(table: Column, _: Column) -> Column:
        def seen(model: Column) -> Column:
            return F.transform(
                table,
                lambda r: F.struct(r["pattern"].alias("pattern"), r["n"].alias("n"), r["votes"].alias("votes"), _posterior(r["votes"], model, m).alias("p")),
            )

        return let(_model(table, m), seen)

    fitted = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("t"), step).alias("t"))
    return fitted.select(F.explode("t").alias("r"), _model(F.col("t"), m).alias("m")).select("r.pattern", F.col("r.p").alias("p_good"), "m.*")


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` without ``text`` and with the counts, ``pattern``, ``p_good``, ``base_failed`` and ``kept``.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated windows.
    kept: not base_failed, and p_good is over KEEP_OVER. A null text counts as empty
    and fails; other null columns pass through; each repeated row is judged by itself; an
    empty table gives an empty result. Columns of ``docs`` that have a name of the result's
    own columns are replaced by these.
    """
    own = [c for c in docs.columns if c == text or c not in ("pattern", "p_good", "base_failed", "kept")]
    counted = text_counts(docs.select(*[F.col(f"`{c}`") for c in own]), text).withColumn("pattern", pattern(rules))
    counted = materialize(counted, "counts")
    found = fit(counted.groupBy("pattern").agg(F.count("*").alias("n")), rules, rounds).select("pattern", "p_good")
    # At most 3 ** len(rules) rows of 12 bytes: 6 MB for twelve rules, if all patterns occur.
    out = counted.join(F.broadcast(found), "pattern", "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") > KEEP_OVER))


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that ``judge`` keeps, all columns as they are.

    The verdict is joined by the key; rows that share a key or have a null one must all be
    kept to stay.
    """
    verdict = judge(docs.select(key, text), text).groupBy(key).agg(F.min("kept").alias("__kept"))
    verdict = verdict.filter("__kept").select(F.col(key).alias("__key"))
    return docs.join(verdict, docs[key].eqNullSafe(verdict["__key"]), "left_semi")


def quality_rules_query(documents: DataFrame) -> DataFrame:
    out = judge(documents.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 4).alias("p_good"))


def oracle() -> str:
    """The same in DuckDB: window counts for the repeats, one materialised step per iteration."""
    m = len(RULES)
    votes = ", ".join(f"CASE WHEN {r.bad} THEN 0 WHEN {r.good} THEN 2 ELSE 1 END AS v{i}" for i, r in enumerate(RULES))
    vs = ", ".join(f"v{i}" for i in range(m))

    def share(i: int, right: int, p: str) -> str:
        return f"({RIGHT} + coalesce(sum(n * {p}) FILTER (v{i} = {right}), 0)) / ({VOTES} + coalesce(sum(n * {p}) FILTER (v{i} <> 1), 0))"

    model = [x for i in range(m) for x in (f"{share(i, 2, 'p')} AS g{i}", f"{share(i, 0, '(1 - p)')} AS b{i}")]
    odds = " + ".join(["ln(c) - ln(1 - c)", *(f"CASE v{i} WHEN 2 THEN ln(g{i}) - ln(1 - b{i}) WHEN 0 THEN ln(1 - g{i}) - ln(b{i}) ELSE 0 END" for i in range(m))])
    good, bad = (" + ".join(f"(v{i} = {k})::INT" for i in range(m)) for k in (2, 0))
    steps = [f"t0 AS MATERIALIZED (SELECT {vs}, n, (1.0::DOUBLE + {good}) / (2.0 + {good} + {BAD_WEIGHT} * ({bad})) AS p FROM pat)"]
    for k in range(ROUNDS):
        steps.append(f"m{k} AS MATERIALIZED (SELECT {', '.join(model)}, (1 + sum(n * p)) / (2 + sum(n)) AS c FROM t{k})")
        steps.append(f"t{k + 1} AS MATERIALIZED (SELECT {vs}, n, 1 / (1 + exp(-({odds}))) AS p FROM t{k}, m{k})")
    gram = " || ' ' || ".join(f"lead(w, {j}) OVER d" if j else "w" for j in range(5))
    near = " OR ".join(f"lag(again, {j}, false) OVER d" if j else "again" for j in range(5))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
g AS (SELECT r, i, w, {gram} AS g FROM w WINDOW d AS (PARTITION BY r ORDER BY i)),
a AS (SELECT r, i, w, g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 AS again FROM g),
c AS (SELECT r, w, {near} AS covered FROM a WINDOW d AS (PARTITION BY r ORDER BY i)),
n AS (SELECT r, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, count(*) FILTER (covered) AS n_repeat_words, count(DISTINCT w) AS n_distinct FROM c GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
f AS (SELECT d.r, doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '\\p{{L}}')) AS n_letters, coalesce(n_distinct, 0) AS n_distinct,
  len(regexp_extract_all(text, '{MARKS}')) AS n_marks, len(regexp_extract_all(text, '{ENDS}')) AS n_ends, len(regexp_extract_all(text, '{BROKEN}')) AS n_broken, len(regexp_extract_all(text, '{LATIN}')) AS n_latin, len(regexp_extract_all(text, '{VOWELS}')) AS n_vowels
  FROM d LEFT JOIN n USING (r) LEFT JOIN l USING (r)),
v AS MATERIALIZED (SELECT *, {votes} FROM f),
pat AS MATERIALIZED (SELECT {vs}, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
{', '.join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND p > {KEEP_OVER} AS kept, round(p, 4) AS p_good
FROM v JOIN t{ROUNDS} USING ({vs})"""
