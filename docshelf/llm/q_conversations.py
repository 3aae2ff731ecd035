"""Query of the conversation repair: damaged conversations and their repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .conversation_repair import repair
from .queries import query


def damaged(convs: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone``: one row in twenty each is dropped (kept here as ``gone``), emptied,
    stripped of sentence ends, repeated, or given to the user, by the CRC-32 of ``conv_id:turn``."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = convs.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    text = (F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _repair_sql() -> str:
    """The same repair as a recursion over the messages: per place the least (cost, audit, lines)."""
    def step(place: str, cost: str, letter: str, line: str | None) -> str:
        lines = f"{place}.lines" if line is None else f"list_append({place}.lines, {line})"
        return (f"CASE WHEN {place} IS NOT NULL THEN {{'cost': {place}.cost + {cost}, 'audit': {place}.audit || '{letter}', "
                f"'lines': {lines}}} END")

    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    insert_user = [step(p, "3", "I", "'user:'") for p in ("s0", "s1", "s3")]
    insert_assistant = step("s2", "3", "I", "'assistant:'")
    stays = lambda x: f"CASE WHEN fault NOT IN ('b', 'd') THEN {x} END"
    keep = lambda p, ini: f"CASE WHEN initial = '{ini}' THEN {step(p, 'extra', 'K', 'line')} END"
    to_user = [stays(f) for p in ("s0", "s1", "s3") for f in (keep(p, "u"), step(p, "3 + extra", "R", "'user:' || text"))]
    to_assistant = [stays(f) for f in (keep("s2", "a"), step("s2", "3 + extra", "R", "'assistant:' || text"))]
    gone = [step(f"s{p}", "4", "D", None) for p in range(4)]
    return f"""
    WITH RECURSIVE c AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
                       string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                       lambda ch: ascii(ch)::BIGINT)),
                   lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                       lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 20 AS kind
        FROM conversations),
    damage AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
        FROM c WHERE kind <> 0),
    o AS (SELECT *, rtrim(text, E' \\t\\n\\x0b\\x0c\\r') AS bare, left(role, 1) AS initial, role || ':' || text AS line,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 8), left(text, 32), role, text, copy) AS i
          FROM damage),
    f0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS met,
                  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
    f AS MATERIALIZED (
        SELECT *, CASE WHEN bare = '' THEN 'b' WHEN met > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
        FROM f0),
    m AS MATERIALIZED (SELECT conv_id, i, initial, line, text, fault, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS extra FROM f),
    walk AS (
        SELECT conv_id, 0::BIGINT AS i, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS s0,
               NULL::STRUCT(cost INTEGER, audit VARCHAR, lines VARCHAR[]) AS s1,
               NULL::STRUCT(cost INTEGER, audit VARCHAR, lines VARCHAR[]) AS s2,
               NULL::STRUCT(cost INTEGER, audit VARCHAR, lines VARCHAR[]) AS s3
        FROM (SELECT DISTINCT conv_id FROM f)
        UNION ALL
        SELECT conv_id, i, {gone[0]}, {least(gone[1], stays(keep("s0", "s")))},
               {least(gone[2], *to_user)}, {least(gone[3], *to_assistant)}
        FROM (SELECT w.conv_id, m.i, initial, line, text, fault, extra, s0, s1,
                     {least("s2", *insert_user)} AS s2, {least("s3", insert_assistant)} AS s3
              FROM walk w JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1)),
    ends AS (
        SELECT conv_id, {least("s0", "s3", insert_assistant, step("s1", "6", "II", "'user:'").replace(
            "list_append(s1.lines, 'user:')", "list_concat(s1.lines, ['user:', 'assistant:'])"))} AS best
        FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
    facts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
               count(*) FILTER (fault = 't') AS truncated,
               count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
        FROM f GROUP BY conv_id)
    SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
           coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, E'\\n'), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a
    LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM a.conv_id
    LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM a.conv_id
    """


@query("op11_conversation_repair", sql=_repair_sql())
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return repair(damaged(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")), gone=F.col("gone"))
