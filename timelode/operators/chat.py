"""Chat sessions: history, answers from sources, turns saved, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelode.functions.text import truncated
from timelode.operators.maintenance import upsert
from timelode.operators.nearest import top_within

# What is said without sources, and before the excerpts.
NO_SOURCES = "Non ho trovato informazioni sufficienti nelle fonti del progetto per rispondere."
FROM_SOURCES = "Risposta basata solo sulle fonti recuperate:"


def last_turns(messages: DataFrame, n: int = 8) -> DataFrame:
    """session_id, history: the last n messages (session_id, id, role, content, created_at) as lines in order."""
    recent = top_within(messages, ["session_id"], [F.desc("created_at"), F.desc("id")], n)
    line = F.struct("created_at", "id", F.concat("role", F.lit(": "), "content").alias("line"))
    return recent.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("history"))


def answers(questions: DataFrame, sources: DataFrame, *, most: int = 4, chars: int = 300) -> DataFrame:
    """question_id, answer: excerpts of the first sources (question_id, place, text) as a cited list under a fixed
    line, a fixed refusal for a question without sources."""
    line = F.concat(F.lit("- "), truncated(F.col("text"), chars), F.lit(" ["), F.col("place").cast("string"), F.lit("]"))
    told = sources.where(F.col("place") <= most).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    joined = questions.select("question_id").distinct().join(told, "question_id", "left")
    return joined.select("question_id", F.coalesce(F.concat(F.lit(FROM_SOURCES + "\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")), F.lit(NO_SOURCES)).alias("answer"))


def save_sessions(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions (id, title, default_source, created_at, updated_at) with new ones merged in: a title is kept
    unless a new one is given, the creation time always."""
    return upsert(sessions, new, key="id", keep=["created_at"], fill=["title"])


def listed_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("updated_at"), "id")


def snapshots(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """session_id, document: one JSON document per session with its messages in order."""
    turns = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "role", "content"))).alias("messages"))
    rows = sessions.withColumnRenamed("id", "session_id").join(turns, "session_id", "left")
    return rows.select("session_id", F.to_json(F.struct("session_id", "title", F.coalesce("messages", F.array().cast("array<struct<created_at:string,id:string,role:string,content:string>>")).alias("messages"))).alias("document"))


def numbered(df: DataFrame, key: str, order: list[str], kind: str, first: int = 1) -> DataFrame:
    """`ordinal` and `new_id` (key_kind_0001, ..) of each key's rows in order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) + (first - 1)
    return df.withColumn("ordinal", place).withColumn("new_id", F.format_string(f"%s_{kind}_%04d", F.col(key), F.col("ordinal")))
