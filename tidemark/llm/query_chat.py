"""op1: all conversations as linked calls.

The table has plain turns, so they are read as calls. A user turn calls the tool `write` if its text has at least LONG characters, else `reply`; its arguments
are the text, the turn's number (written as a string where the length of the text is a multiple of seven) and the number of line ends if
there are any. `write` requires that number and `reply` doesn't know it, so arguments of every kind of fault occur. The assistant turn right
after a call is its result. A call depends on the turn two before it, one at turn 6 or 7 also on those four and six before, and one at turn 2 or 3 with
a length that is a multiple of five on the one two after it, which makes a cycle; turns that are no calls are unknown dependencies. A
turn without a conversation has no id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import link_tool_calls
from .common import table

LONG = 300
_BOTH = {"text": ("string", True), "turn": ("integer", True)}
TOOLS = {"reply": _BOTH, "write": {**_BOTH, "lines": ("integer", True)}}


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    # concat, unlike concat_ws, is null with a null part.
    name = lambda back: F.concat(F.lit("call:"), F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))
    length, turn = F.coalesce(F.length("text"), F.lit(0)), F.col("turn")
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    count = lambda odd: F.struct("text", (turn.cast("string") if odd else turn).alias("turn"), F.when(lines > 0, lines.cast("long")).alias("lines"))
    after = F.array(
        F.when(turn >= 2, name(2)), F.when(turn.isin(6, 7), name(4)), F.when(turn.isin(6, 7), name(6)), F.when(turn.isin(2, 3) & (length % 5 == 0), name(-2))
    )
    calls = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", name(0).alias("call_id"), F.when(length >= LONG, "write").otherwise("reply").alias("name"),
        F.when(length % 7 == 0, F.to_json(count(True))).otherwise(F.to_json(count(False))).alias("arguments"), F.array_compact(after).alias("after"),
    )
    results = turns.where(F.col("role") == "assistant").select(name(1).alias("call_id"), "turn", F.col("text").alias("content"))
    linked = link_tool_calls(calls, results, TOOLS)
    return linked.select("conv_id", "turn", "call_id", "level", "valid", F.concat_ws(",", "errors").alias("errors"), "result_turn", "n_results", "message")


QUERIES = {"op1_tool_calls": chats}
SQL = {
    "op1_tool_calls": f"""
WITH RECURSIVE users AS (
  SELECT *, 'call:' || conv_id || ':' || turn AS id, coalesce(length(text), 0) AS n, length(text) - length(replace(text, chr(10), '')) AS ends,
         CASE WHEN coalesce(length(text), 0) >= {LONG} THEN 'write' ELSE 'reply' END AS tool
  FROM conversations WHERE role = 'user'),
wanted AS (
  SELECT DISTINCT id, 'call:' || conv_id || ':' || p AS parent
  FROM (SELECT *, unnest([turn - 2, CASE WHEN turn IN (6, 7) THEN turn - 4 END, CASE WHEN turn IN (6, 7) THEN turn - 6 END, CASE WHEN turn IN (2, 3) AND n % 5 = 0 THEN turn + 2 END]) AS p FROM users)
  WHERE p >= 0 AND id IS NOT NULL),
needs AS (SELECT * FROM wanted WHERE parent IN (SELECT id FROM users)),
lost AS (SELECT DISTINCT id FROM wanted WHERE parent NOT IN (SELECT id FROM users WHERE id IS NOT NULL)),
reach AS (SELECT id, parent FROM needs UNION SELECT r.id, n.parent FROM reach r JOIN needs n ON r.parent = n.id),
round AS (SELECT DISTINCT id FROM reach WHERE id = parent),
open AS (SELECT id FROM round UNION SELECT id FROM reach WHERE parent IN (SELECT id FROM round)),
depth AS (
  SELECT DISTINCT id, CAST(0 AS BIGINT) AS level FROM users WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM open)
  UNION SELECT n.id, d.level + 1 FROM depth d JOIN needs n ON n.parent = d.id WHERE n.id NOT IN (SELECT id FROM open)),
levels AS (SELECT id, max(level) AS level FROM depth GROUP BY id),
results AS (SELECT conv_id, turn - 1 AS turn, min(turn) AS result_turn, min(text) AS content, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn),
judged AS (
  SELECT u.*, l.level, r.result_turn, r.content, coalesce(r.n, 0) AS n_results,
         list_concat(list_sort(list_filter([
           CASE WHEN tool = 'reply' AND ends > 0 THEN 'unknown key' END, CASE WHEN tool = 'write' AND coalesce(ends, 0) = 0 THEN 'missing lines' END,
           CASE WHEN text IS NULL THEN 'missing text' END, CASE WHEN u.n % 7 = 0 THEN 'turn is not integer' END], lambda e: e IS NOT NULL)),
           CASE WHEN lost.id IS NULL THEN [] ELSE ['unknown dependency'] END) AS faults,
         CASE WHEN ends > 0 THEN '"lines":' || ends || ',' ELSE '' END || CASE WHEN text IS NULL THEN '' ELSE '"text":' || CAST(to_json(text) AS VARCHAR) || ',' END
           || CASE WHEN u.n % 7 = 0 THEN '"turn":"' || u.turn || '"' ELSE '"turn":' || u.turn END AS arguments
  FROM users u LEFT JOIN levels l ON u.id = l.id LEFT JOIN lost ON u.id = lost.id LEFT JOIN results r ON u.conv_id = r.conv_id AND u.turn = r.turn)
SELECT conv_id, turn, id AS call_id, level, len(faults) = 0 AS valid, array_to_string(faults, ',') AS errors, result_turn, n_results,
       '{{"arguments":{{' || arguments || '}},"id":' || coalesce('"' || id || '"', 'null') || ',"level":' || coalesce(CAST(level AS VARCHAR), 'null') ||
       ',"name":"' || tool || '","result":' || CASE WHEN content IS NULL THEN 'null' ELSE CAST(to_json(content) AS VARCHAR) END || '}}' AS message
FROM judged"""
}
