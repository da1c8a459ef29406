"""Multi-party chat formatting by perspective rotation.

Every participant of a dialogue gets a rendering of it in which that speaker is the
assistant, and the others are users with their names; the mask gives the stretches of
characters to learn from, the assistant's contents.

Contents and names are data: a zero-width joiner goes behind the ``<`` of every control
token in them, and line ends in names become blanks, so no text can open or close a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
MARK, ESCAPED = "<|im_", "<\u200d|im_"


def escaped(text: Column) -> Column:
    """``text`` without control tokens; the mark that is put in can be taken out again."""
    return F.replace(text, F.lit(MARK), F.lit(ESCAPED))


def name(role: Column) -> Column:
    """A role as it stands in a head: one line, no control token."""
    return F.translate(escaped(role), "\n\r", "  ")


def _render(msgs: Column, who: Column) -> Column:
    """The segment's text: system messages as they are, ``who`` as assistant, others by name."""

    def one(m: Column) -> Column:
        head = F.when(m["role"] == "system", "system").when(m["role"] == who, "assistant").otherwise(F.concat(F.lit("user name="), name(m["role"])))
        own = (m["role"] != "system") & (m["role"] == who)
        before = F.concat(F.lit(OPEN), head, F.lit("\n"))
        return F.struct(F.concat(before, m["text"], F.lit(CLOSE)).alias("text"), F.length(before).alias("skip"), F.length(m["text"]).alias("n"), own.alias("own"))

    return F.transform(msgs, one)


def _spans(parts: Column) -> Column:
    """'start:end' of every own content, joined by commas, from a running offset."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("target"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, p: Column) -> Column:
        lo = acc["at"] + p["skip"]
        span = F.concat(lo.cast("string"), F.lit(":"), (lo + p["n"]).cast("string"))
        return F.struct(
            (acc["at"] + F.length(p["text"])).alias("at"),
            (acc["target"] + F.when(p["own"], p["n"]).otherwise(0)).alias("target"),
            F.when(p["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(parts, start, add)


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int | None = None) -> DataFrame:
    """Per (conv, participant, segment): rendered, mask, n_turns, n_target.

    A dialogue is rendered whole, in segment 0: a row is as long as its dialogue. With
    ``segment`` it is cut by turn number instead, and the dialogue's leading system messages
    stand before every segment. Participants are the roles of the whole dialogue but
    ``system``; a dialogue of only system messages has none and gives no row. Messages stand
    in the order of turn, role, text. Repeated rows are one message. A null role or text
    counts as empty; a null turn comes first, in segment 0; a null conv is a dialogue of its
    own. Other columns are not read. Offsets of the mask count characters of ``rendered``.
    """
    msgs = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).distinct()
    part = F.lit(0).cast("long") if segment is None else F.coalesce(F.floor(F.col("turn") / segment), F.lit(0)).cast("long")
    message = F.struct("turn", "role", escaped(F.col("text")).alias("text"))
    held = msgs.groupBy("conv", part.alias("segment")).agg(F.sort_array(F.collect_list(message)).alias("msgs"), F.collect_set("role").alias("roles"))
    if segment is None:
        joined = held.withColumn("participant", F.explode(F.array_remove("roles", "system")))
    else:
        first = msgs.filter("role <> 'system'").groupBy(F.col("conv").alias("n")).agg(F.min(F.struct("turn", "role", "text")).alias("first"), F.collect_set("role").alias("names"))
        opening = msgs.join(first, F.col("conv").eqNullSafe(F.col("n"))).filter(F.struct("turn", "role", "text") < F.col("first"))
        opening = opening.groupBy(F.col("conv").alias("c")).agg(F.sort_array(F.collect_list(message)).alias("lead"))
        joined = held.join(first, F.col("conv").eqNullSafe(F.col("n"))).join(opening, F.col("conv").eqNullSafe(F.col("c")), "left")
        repeated = F.when(F.col("segment") > 0, F.coalesce("lead", F.array().cast(held.schema["msgs"].dataType))).otherwise(F.array().cast(held.schema["msgs"].dataType))
        joined = joined.withColumn("msgs", F.concat(repeated, "msgs")).withColumn("participant", F.explode("names"))
    parts = joined.select("conv", "participant", "segment", _render(F.col("msgs"), F.col("participant")).alias("parts"))
    done = parts.select("*", _spans(F.col("parts")).alias("m"))
    return done.select(
        F.col("conv").alias(conv),
        "participant",
        "segment",
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("rendered"),
        F.array_join("m.spans", ",").alias("mask"),
        F.size("parts").cast("long").alias("n_turns"),
        F.col("m.target").cast("long").alias("n_target"),
    )


ORACLE = f"""
WITH raw AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
m AS (SELECT conv_id, turn, role, translate(replace(role, '{MARK}', '{ESCAPED}'), chr(10) || chr(13), '  ') AS name, replace(text, '{MARK}', '{ESCAPED}') AS text FROM raw),
p AS (SELECT DISTINCT conv_id, role AS participant FROM m WHERE role <> 'system'),
r AS (SELECT m.conv_id, participant, turn, role, text, role = participant AS own,
  '{OPEN}' || CASE WHEN role = 'system' THEN 'system' WHEN role = participant THEN 'assistant' ELSE 'user name=' || name END || chr(10) AS head
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS part FROM r),
s AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS lo FROM o)
SELECT conv_id, participant, 0::BIGINT AS segment, string_agg(part, '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
  coalesce(string_agg(lo::BIGINT || ':' || (lo + length(text))::BIGINT, ',' ORDER BY turn NULLS FIRST, role, text) FILTER (own), '') AS mask,
  count(*) AS n_turns, coalesce(sum(length(text)) FILTER (own), 0)::BIGINT AS n_target
FROM s GROUP BY conv_id, participant"""
