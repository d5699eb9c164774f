"""Chat formatting (operator 8): every participant's view of a dialogue.

For each participant (each speaker but ``system``) the whole dialogue is
rendered with that speaker as the assistant and everyone else as a named user;
system turns stay system turns.  The loss mask covers what the assistant says in
that view, its end mark included, and nothing else.

A dialogue is rendered in blocks of ``BLOCK`` turn numbers, so one conversation
may hold any share of all rows: an ordinary one has one block, a long one
several, each with where it starts in the whole view.  Turns are shuffled once,
by conversation and block; the participants of a conversation and the blocks'
starts, from sums of turn lengths, travel to its blocks as one slim table.

Defined results: turns are ordered by turn (null first), speaker and text, and
repeated rows are all rendered; a null role speaks as ``unknown``, a null text is
an empty turn; rows without a conv_id form one conversation with a null id; a
conversation of system turns alone has no view; marks inside a text or name are
broken up, so no text can end its turn; an empty table yields no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 256
SYSTEM, UNKNOWN = "system", "unknown"
END = "<|end|>\n"
NULL_BLOCK = -(1 << 62)


def _plain(column: Column) -> Column:
    """Text whose marks are broken up."""
    return F.replace(column, F.lit("<|"), F.lit("< |"))


def perspectives(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, perspective, block, block_start, n_turns, n_target, text, spans.

    ``spans`` lists the masked-in ranges of the block's ``text`` as
    ``start-end`` (characters, end exclusive), comma-joined, in order.
    """
    key = ["c", "no_id", "block"]
    said = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("c"),
        F.col("conv_id").isNull().alias("no_id"),
        F.coalesce(F.floor(F.col("turn") / block), F.lit(NULL_BLOCK)).alias("block"),
        "turn",
        _plain(F.coalesce("role", F.lit(UNKNOWN))).alias("speaker"),
        _plain(F.coalesce("text", F.lit(""))).alias("body"),
    ).withColumn("chars", F.char_length("body"))
    speakers = said.filter(F.col("speaker") != SYSTEM).select("c", "no_id", F.col("speaker").alias("perspective")).distinct()
    seats = said.select(*key).distinct().join(speakers, ["c", "no_id"])

    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n"))
    head = head.otherwise(F.concat(F.lit('<|user name="'), F.col("speaker"), F.lit('"|>\n')))
    size = F.char_length(head) + F.col("chars") + len(END)

    view = [*key, "perspective"]
    lengths = said.select(*key, "speaker", "chars").join(seats, key).groupBy(*view).agg(F.sum(size).alias("size"))
    earlier = Window.partitionBy("c", "no_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.select(*view, F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("block_start"))

    order = Window.partitionBy(*view).orderBy("turn", "speaker", "body")
    rows = said.join(starts, key).select(*view, "block_start", "turn", "speaker", "body", own.alias("own"), head.alias("head"), size.alias("size"))
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.select(*view, "block_start", F.row_number().over(order).alias("nth"), before.alias("at"), "head", "body", "own", "size")
    span = F.concat((F.col("at") + F.char_length("head")).cast("string"), F.lit("-"), (F.col("at") + F.col("size")).cast("string"))
    segment = F.struct("nth", F.concat("head", "body", F.lit(END)).alias("segment"), F.when(F.col("own"), span).alias("span"))
    blocks = placed.groupBy(*view, "block_start").agg(
        F.sort_array(F.collect_list(segment)).alias("parts"), F.count("*").alias("n_turns"), F.count_if("own").alias("n_target")
    )

    return blocks.select(
        F.when(~F.col("no_id"), F.col("c")).alias("conv_id"),
        "perspective",
        F.when(F.col("block") != NULL_BLOCK, F.col("block")).alias("block"),
        "block_start", "n_turns", "n_target",
        F.array_join(F.col("parts.segment"), "").alias("text"),
        F.array_join(F.col("parts.span"), ",").alias("spans"),
    )


SQL = f"""
WITH said AS (
  SELECT conv_id, CAST(floor(turn / {BLOCK}) AS BIGINT) AS block, turn,
         replace(coalesce(role, '{UNKNOWN}'), '<|', '< |') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body
  FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> '{SYSTEM}'
), heads AS (
  SELECT s.*, p.perspective, s.speaker = p.perspective AS own,
         CASE WHEN s.speaker = p.perspective THEN '<|assistant|>' || chr(10)
              WHEN s.speaker = '{SYSTEM}' THEN '<|system|>' || chr(10)
              ELSE '<|user name="' || s.speaker || '"|>' || chr(10) END AS head
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), sized AS (
  SELECT *, length(head) + length(body) + {len(END)} AS size,
         row_number() OVER w AS nth
  FROM heads WINDOW w AS (PARTITION BY conv_id, perspective, block ORDER BY turn NULLS FIRST, speaker, body)
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id, perspective, block ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at
  FROM sized
), blocks AS (
  SELECT conv_id, perspective, block, sum(size) AS size, count(*) AS n_turns, count(*) FILTER (own) AS n_target,
         string_agg(head || body || '<|end|>' || chr(10), '' ORDER BY nth) AS text,
         coalesce(string_agg(CASE WHEN own THEN CAST(begin_at + length(head) AS VARCHAR) || '-' || CAST(begin_at + size AS VARCHAR) END, ',' ORDER BY nth), '') AS spans
  FROM placed GROUP BY ALL
)
SELECT conv_id, perspective, block,
       CAST(coalesce(sum(size) OVER (PARTITION BY conv_id, perspective ORDER BY block NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_start,
       n_turns, n_target, text, spans
FROM blocks
"""
