"""Preference formatting in DataFrame functions alone.

A pair of conversations, chosen and rejected, shares its longest common prefix of turns. That prefix is
rendered once as the prompt; what is left of each side becomes a completion with a mask that trains on the
assistant's turns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: How a turn is rendered (fixed format): header, text, end.
HEAD, NECK, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def _turns(*, only: Column | None = None) -> Column:
    """A conversation's distinct turns in order of turn, then role and text; nulls are empty strings."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return F.array_sort(F.collect_set(turn if only is None else F.when(only, turn)))


def _head(x: Column) -> Column:
    return F.concat(F.lit(HEAD), x["role"], F.lit(NECK))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(_head(x), x["text"], F.lit(END))), "")


def _masks(turns: Column) -> Column:
    """Runs of the completion's characters as mask:length, two a turn: the header, then text and end."""
    body = lambda x: F.concat(F.when(x["role"] == TRAINED, F.lit("1:")).otherwise(F.lit("0:")), (F.length(x["text"]) + len(END)).cast("string"))
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit("0:"), F.length(_head(x)).cast("string"), F.lit(","), body(x))), ",")


def _paired(pairs: DataFrame, key: str) -> DataFrame:
    """Rows of key, c and r (arrays of turns) as prompts and masked completions."""
    same = F.zip_with("c", "r", lambda x, y: (x["role"].eqNullSafe(y["role"])) & (x["text"].eqNullSafe(y["text"])))
    least = F.least(F.size("c"), F.size("r"))
    first = F.array_position(F.slice(same, F.lit(1), least), F.lit(False))
    pairs = pairs.withColumn("n", F.when(first > 0, (first - 1).cast("int")).otherwise(least))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.size(side))
    pairs = pairs.select(key, F.col("n").cast("long").alias("n_prompt_turns"), F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return pairs.select(
        key,
        "n_prompt_turns",
        _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"),
        _rendered(F.col("r")).alias("rejected"),
        _masks(F.col("c")).alias("chosen_mask"),
        _masks(F.col("r")).alias("rejected_mask"),
    )


def preference_pairs(turns: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row a pair from turns with columns key, side ('chosen' or 'rejected'), turn, role and text.

    Repeated rows count once and ties of turn are ordered by role and text, so the result doesn't depend on
    the rows' order; null roles and texts are empty, null turns come first, a side without rows is empty.
    A null key is a pair of its own; an empty table gives no rows; other columns are ignored. One shuffle
    by key; what meets in a row is one pair, which its own output row holds as a whole.
    """
    rows = turns.select(F.col(key).cast("long").alias(key), "side", "turn", "role", "text")
    return _paired(rows.groupBy(key).agg(_turns(only=F.col("side") == "chosen").alias("c"), _turns(only=F.col("side") == "rejected").alias("r")), key)


def regenerated_pairs(conversations: DataFrame) -> DataFrame:
    """Each conversation as chosen against its own stale answer as rejected.

    The rejected side ends with the last assistant turn, whose text is that of the assistant turn before (or
    empty if there is none); a conversation without assistant turns is the same on both sides, so all of it
    is prompt. Nulls, ties and repeated rows as in preference_pairs(), key conv_id.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").groupBy("conv_id").agg(_turns().alias("c"))
    rows = rows.withColumn("said", F.filter(F.transform("c", lambda x, i: F.when(x["role"] == TRAINED, i + 1)), lambda i: i.isNotNull()))
    last, before = F.get("said", F.size("said") - 1), F.get("said", F.size("said") - 2)
    stale = F.struct(F.get("c", last - 1)["turn"].alias("turn"), F.lit(TRAINED).alias("role"), F.coalesce(F.get("c", before - 1)["text"], F.lit("")).alias("text"))
    rows = rows.withColumn("r", F.when(F.size("said") == 0, F.col("c")).otherwise(F.concat(F.slice("c", F.lit(1), last - 1), F.array(stale))))
    return _paired(rows, "conv_id")


def query(spark, sf_dir: str) -> DataFrame:
    return regenerated_pairs(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), conv AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS c FROM turns GROUP BY conv_id
), said AS (
  SELECT *, list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant') AS s FROM conv
), pairs AS (
  SELECT conv_id, c, CASE WHEN len(s) = 0 THEN c ELSE list_concat(c[:s[-1] - 1],
    [{'role': 'assistant', 'text': CASE WHEN len(s) > 1 THEN c[s[-2]].text ELSE '' END}]) END AS r FROM said
), cut AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] <> r[i])) - 1, least(len(c), len(r))) AS n FROM pairs
)
SELECT conv_id, n AS n_prompt_turns,
  coalesce(array_to_string(list_transform(c[:n], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(c[n + 1:], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(r[n + 1:], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), ''), '') AS rejected,
  coalesce(array_to_string(list_transform(c[n + 1:], lambda x: '0:' || (length(x.role) + 5) || CASE WHEN x.role = 'assistant' THEN ',1:' ELSE ',0:' END || (length(x.text) + 8)), ','), '') AS chosen_mask,
  coalesce(array_to_string(list_transform(r[n + 1:], lambda x: '0:' || (length(x.role) + 5) || CASE WHEN x.role = 'assistant' THEN ',1:' ELSE ',0:' END || (length(x.text) + 8)), ','), '') AS rejected_mask
FROM cut
"""
