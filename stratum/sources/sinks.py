"""Writers: append logs, grouped overwrites, and one row of JSON for a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite_groups(df: DataFrame, path: str, group: str) -> None:
    """Each group of df replaces its folder; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(path)


def envelope(entries: DataFrame, *distinct: str) -> DataFrame:
    """One row: the count and the distinct values of some columns of a manifest."""
    return entries.agg(F.count("*").alias("count"), *[F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in distinct])


def write_targets(df: DataFrame, *paths: str) -> None:
    """The same rows as JSON lines in several places: computed once, then copied from the first."""
    first, *others = paths
    df.write.mode("overwrite").json(first)
    for path in others:
        df.sparkSession.read.text(first).write.mode("overwrite").text(path)


def replace_all(df: DataFrame, path: str, group: str) -> None:
    """Each group of df as a folder; folders of groups that df hasn't go."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(group).parquet(path)


def delete_groups(spark: SparkSession, path: str, group: str, gone: DataFrame, to: str) -> None:
    """What is left of the table at path without the groups of gone, as a table at another place."""
    rows = spark.read.parquet(path)
    rows.join(gone.select(group).distinct(), group, "left_anti").write.mode("overwrite").partitionBy(group).parquet(to)


# logs of chats: batches of turns (session_id, turn, query, answer, kind, warnings, citations, at)

#: Kinds of answers that leave a question open.
OPEN_KINDS = ("no_answer", "clarification", "unsupported")


def _audited(turns: DataFrame, record: str) -> DataFrame:
    """Turns with an envelope: an id that depends on session and turn alone, the turn before, and how many citations there are."""
    key = F.concat_ws(":", F.lit(record), "session_id", F.col("turn").cast("string"))
    before = F.when(F.col("turn") > 0, F.concat_ws(":", "session_id", (F.col("turn") - 1).cast("string"))).otherwise("")
    envelope = F.struct(F.md5(key).alias("record_id"), "session_id", F.col("turn").alias("turn_index"), F.concat_ws(":", "session_id", F.col("turn").cast("string")).alias("turn_id"), before.alias("parent_turn_id"), F.col("at").alias("created_at"))
    return turns.filter("session_id IS NOT NULL AND turn IS NOT NULL").select(F.lit(record).alias("record_kind"), envelope.alias("audit_envelope"), *[c for c in turns.columns if c not in ("record_kind", "audit_envelope")])


def log_turns(turns: DataFrame, path: str, batch: int) -> None:
    """A batch of turns as records in a folder of its own: one that is written again, after a lost executor or a restart, replaces itself."""
    _audited(turns, "chat_turn_audit").write.mode("overwrite").json(f"{path.rstrip('/')}/batch={batch}")


def log_unanswered(turns: DataFrame, path: str, batch: int, kinds: tuple[str, ...] = OPEN_KINDS) -> None:
    """The same for turns whose question stays open: by the answer's kind, or as it has a warning and no citation."""
    bare = (F.size(F.coalesce("citations", F.array().cast("array<string>"))) == 0) & (F.size(F.coalesce("warnings", F.array().cast("array<string>"))) > 0)
    rows = turns.filter(F.coalesce(F.col("kind").isin(*kinds), F.lit(False)) | bare)
    _audited(rows, "unanswered_question").select("record_kind", "audit_envelope", "session_id", "query", "kind", "warnings", "at").write.mode("overwrite").json(f"{path.rstrip('/')}/batch={batch}")


def snapshot_sessions(turns: DataFrame, path: str, kept: int = 20) -> None:
    """Each session with its last turns, in order, as one row in its own folder, which replaces an older one. turns: all turns of the sessions that changed."""
    rows = turns.filter("session_id IS NOT NULL AND turn IS NOT NULL")
    last = F.slice(F.sort_array(F.collect_set(F.struct("turn", "query", "answer", "at")), asc=False), 1, kept)
    overwrite_groups(rows.groupBy("session_id").agg(F.count_distinct("turn").alias("n_turns"), F.max("at").alias("updated_at"), F.array_sort(last).alias("history")), path, "session_id")
