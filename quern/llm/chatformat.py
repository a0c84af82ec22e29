"""Preference formatting: one prompt, two masked completions.

The longest common turn prefix of a chosen and a rejected conversation is
rendered once as the prompt; the turns after it become the two completions, with
masks over what the assistant says there.  Windows over one shuffle by pair do
all of it: no Python, no join, no list of turns before the last aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import table

HEAD, AFTER_ROLE, FOOT = "<|", "|>\n", "<|end|>\n"


def preference_pairs(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per pair: (pair_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask).

    ``turns`` has pair_id, side (``chosen`` or ``rejected``), turn, role and text.
    Turns are read by turn (nulls last), then role, then text; repeated rows are
    turns of their own.  Two turns are common if role and text are equal or both
    null; a null role is rendered as ``unknown``, a null text as empty.  A mask is a
    comma-joined list of start-end character offsets into its completion.  A pair
    without one side has an empty prompt and an empty completion for it.  Rows
    without pair_id, and of other sides, are left out.
    """
    rows = turns.select("pair_id", "side", "turn", "role", "text").where(
        "pair_id is not null and side in ('chosen', 'rejected')"
    )
    rows = rows.repartition("pair_id")
    order = (F.asc_nulls_last("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("pair_id", "side").orderBy(*order)))
    at, pair = Window.partitionBy("pair_id", "pos"), Window.partitionBy("pair_id")
    what = F.struct("role", "text")
    same = (F.count("*").over(at) == 2) & F.min(what).over(at).eqNullSafe(F.max(what).over(at))
    rows = rows.withColumn("same", same)
    first = F.min(F.when(~F.col("same"), F.col("pos"))).over(pair)
    rows = rows.withColumn("prefix", F.coalesce(first - 1, F.max("pos").over(pair)))
    head = F.concat(F.lit(HEAD), F.coalesce("role", F.lit("unknown")), F.lit(AFTER_ROLE))
    rows = rows.withColumn("head", F.length(head)).withColumn(
        "shown", F.concat(head, F.coalesce("text", F.lit("")), F.lit(FOOT))
    )
    in_prompt = F.col("pos") <= F.col("prefix")
    side = Window.partitionBy("pair_id", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.when(in_prompt, 0).otherwise(F.length("shown"))).over(side)
    rows = rows.withColumn("end", end)
    spoken = F.when(
        F.col("role") == trained_role,
        F.concat(F.col("end") - F.length("shown") + F.col("head"), F.lit("-"), F.col("end").cast("string")),
    )

    def joined(where, value, sep):
        kept = F.sort_array(F.collect_list(F.when(where & value.isNotNull(), F.struct("pos", value.alias("v")))))
        return F.array_join(F.transform(kept, lambda x: x["v"]), sep)

    done = {s: ~in_prompt & (F.col("side") == s) for s in ("chosen", "rejected")}
    return rows.groupBy("pair_id").agg(
        F.max("prefix").cast("long").alias("prompt_turns"),
        joined(in_prompt & (F.col("side") == "chosen"), F.col("shown"), "").alias("prompt"),
        *(
            part
            for s in ("chosen", "rejected")
            for part in (
                joined(done[s], F.col("shown"), "").alias(s),
                joined(done[s], spoken, ",").alias(f"{s}_mask"),
            )
        ),
    )


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    """Conversations 2n and 2n + 1 are the chosen and the rejected one of pair n."""
    turns = table(spark, sf_dir, "conversations")
    side = F.when(F.col("conv_id") % 2 == 0, "chosen").otherwise("rejected")
    pair = F.shiftright(F.col("conv_id"), 1).alias("pair_id")
    return preference_pairs(turns.select(pair, side.alias("side"), "turn", "role", "text"))


ORACLE_SQL = f"""
WITH t AS (
  SELECT CAST(conv_id >> 1 AS BIGINT) AS pair_id,
    CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
same AS (
  SELECT pair_id, pos, count(*) = 2 AND count(DISTINCT coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n')) = 1 AS same
  FROM t GROUP BY pair_id, pos),
prefix AS (
  SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN pos END) - 1, max(pos)) AS prefix FROM same GROUP BY pair_id),
shown AS (
  SELECT t.pair_id, side, pos, prefix, role,
    length('{HEAD}' || coalesce(role, 'unknown') || '|>' || chr(10)) AS head,
    '{HEAD}' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS s
  FROM t JOIN prefix ON t.pair_id = prefix.pair_id),
placed AS (
  SELECT *, sum(CASE WHEN pos <= prefix THEN 0 ELSE length(s) END) OVER (PARTITION BY pair_id, side ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM shown),
masked AS (
  SELECT *, CASE WHEN role = 'assistant' THEN CAST(e - length(s) + head AS BIGINT) || '-' || CAST(e AS BIGINT) END AS m FROM placed)
SELECT pair_id, max(prefix) AS prompt_turns,
  coalesce(string_agg(s, '' ORDER BY pos) FILTER (WHERE pos <= prefix AND side = 'chosen'), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY pos) FILTER (WHERE pos > prefix AND side = 'chosen'), '') AS chosen,
  coalesce(string_agg(m, ',' ORDER BY pos) FILTER (WHERE pos > prefix AND side = 'chosen'), '') AS chosen_mask,
  coalesce(string_agg(s, '' ORDER BY pos) FILTER (WHERE pos > prefix AND side = 'rejected'), '') AS rejected,
  coalesce(string_agg(m, ',' ORDER BY pos) FILTER (WHERE pos > prefix AND side = 'rejected'), '') AS rejected_mask
FROM masked GROUP BY pair_id"""
