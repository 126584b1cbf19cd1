"""Chat formatting: logged snapshots of a conversation collapse to the longest one, which is then rendered.

A log that stores the whole conversation after each turn holds every conversation many times, each time as a prefix of
a longer one. Every turn gets the rolling hash of all turns up to it: the running sum of four 32-bit parts of a
digest of (ordinal, role, text), 128 bits in all, and so a window function, not a loop. A conversation whose last hash
and length equal those of an inner turn of another is a prefix of it; an anti-join drops it. Both sides of that join
are distinct first, so a turn that starts a third of all conversations is one row. Conversations that are equal
throughout keep the smallest conv_id. DataFrame functions only.

Defined results: turns are taken by (turn, role, text), so ties and repeated rows have one order; null role or text is
empty; rows of a null conv_id form one conversation; a conversation is one row of the result, so its text has to stay below 2 GB; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read, scratch, table

ORDER = ("turn", "role", "text")


def hash_parts() -> list[Column]:
    digest = F.sha2(F.to_json(F.struct("pos", "role", "text")), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, pos, role, text and h: the hash of the turns up to pos, with n_turns."""
    by = Window.partitionBy("conv_id")
    order = by.orderBy(*ORDER)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("pos", F.row_number().over(order))
    for k, part in enumerate(hash_parts()):
        rows = rows.withColumn(f"h{k}", part)
    for k in range(4):
        rows = rows.withColumn(f"h{k}", F.sum(f"h{k}").over(running))
    return rows.select("conv_id", "pos", "role", "text", F.concat_ws(":", *(f"h{k}" for k in range(4))).alias("h"), (F.lead("pos").over(order).isNull()).alias("last"))


def maximal(hashed: DataFrame) -> DataFrame:
    """conv_id, pos (its length) and copies of the conversations that no other one continues."""
    ends = hashed.where("last").groupBy("pos", "h").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    inner = hashed.where(~F.col("last")).select("pos", "h").distinct()
    return ends.join(inner, ["pos", "h"], "left_anti")


def render(rows: DataFrame) -> DataFrame:
    """One text per conversation: <|role|>, the turn's text, <|end|>, each on its own line."""
    piece = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))
    turns = F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece"))))
    return rows.groupBy("conv_id").agg(F.max("pos").cast("long").alias("n_turns"), F.max("copies").alias("copies"), F.array_join(F.transform(turns, lambda t: t["piece"]), "").alias("text"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, text of every maximal conversation."""
    with scratch(turns.sparkSession) as work:
        hashed = table(prefix_hashes(turns), "turns")
        kept = maximal(hashed).select(F.col("conv_id").alias("kept_id"), "copies")
        rows = hashed.select("conv_id", "pos", "role", "text").join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
        return work.result(render(rows.drop("kept_id")), "chats")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, count(*) AS n, list(struct_pack(r := role, t := text) ORDER BY turn, role, text) AS turns FROM t GROUP BY conv_id),
u AS (SELECT n, turns, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY n, turns),
p AS (SELECT DISTINCT k AS n, list_slice(turns, 1, k) AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM u))
SELECT u.conv_id, CAST(u.n AS BIGINT) AS n_turns, CAST(u.copies AS BIGINT) AS copies,
       array_to_string(list_transform(u.turns, lambda x: '<|' || x.r || '|>' || chr(10) || x.t || chr(10) || '<|end|>' || chr(10)), '') AS text
FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n = u.n AND p.turns = u.turns)
"""
