"""Last writer wins: shelves merged from many devices, and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOOKS, EDITS_A_BOOK, EDITS_A_REQUEST = 2000, 5000, 500


def merge_edits(changes: DataFrame) -> DataFrame:
    """The standing edit of each (account, book, h): the newest by the client's clock, the later arrival of two as new.

    One partial aggregate; no window over a hot key.
    """
    rest = [c for c in changes.columns if c not in ("account_id", "book_id", "h")]
    best = F.max_by(F.struct(*rest), F.struct("at", "arrival")).alias("r")
    return changes.groupBy("account_id", "book_id", "h").agg(best).select("account_id", "book_id", "h", "r.*")


def merge_entries(changes: DataFrame, fields: list[str]) -> DataFrame:
    """The standing entry of each (account, book), field by field: the newest change that gives the field.

    This is the replay in the order of (at, arrival). A replay in order of arrival differs where
    a partial change overtakes an older full one: it would keep the field empty. Stated choice.
    """
    order = F.struct("at", "arrival")
    newest = [F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
    return changes.groupBy("account_id", "book_id").agg(*newest, F.max("at").alias("at"))


def replay_entries(changes: DataFrame, fields: list[str]) -> DataFrame:
    """The entry after a replay in order of arrival: a change at least as new as the entry gives its
    fields where it has any; an older one changes nothing. A fold over one key's changes."""
    rows = changes.groupBy("account_id", "book_id").agg(F.array_sort(F.collect_list(F.struct("arrival", "at", *fields))).alias("a"))
    none = F.struct(F.lit(None).cast(changes.schema["at"].dataType).alias("at"), *[F.lit(None).cast(changes.schema[f].dataType).alias(f) for f in fields])

    def step(s: Column, c: Column) -> Column:
        newer = s["at"].isNull() | (c["at"] >= s["at"])
        return F.struct(F.greatest(s["at"], c["at"]).alias("at"), *[F.when(newer, F.coalesce(c[f], s[f])).otherwise(s[f]).alias(f) for f in fields])

    return rows.select("account_id", "book_id", F.aggregate("a", none, step).alias("s")).select("account_id", "book_id", "s.*")


def over_quota(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """(account_id, book_id, what, n): shelves and books past what they may hold."""
    books = entries.groupBy("account_id").agg(F.count("*").alias("n")).filter(F.col("n") > BOOKS)
    many = edits.groupBy("account_id", "book_id").agg(F.count("*").alias("n")).filter(F.col("n") > EDITS_A_BOOK)
    return books.select("account_id", F.lit(None).cast("string").alias("book_id"), F.lit("books").alias("what"), "n").unionByName(many.select("account_id", "book_id", F.lit("edits").alias("what"), "n"))


def cascade(edits: DataFrame, gone: DataFrame) -> DataFrame:
    """Edits without those of deleted entries."""
    return edits.join(gone.select("account_id", "book_id").distinct(), ["account_id", "book_id"], "left_anti")


def read_shelf(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """Entries with their edits as one array by time; an entry without edits has an empty one."""
    per = edits.groupBy("account_id", "book_id").agg(F.array_sort(F.collect_list(F.struct("at", "h", "base_hash", "text"))).alias("edits"))
    empty = F.array().cast(per.schema["edits"].dataType)
    return entries.join(per, ["account_id", "book_id"], "left").withColumn("edits", F.coalesce("edits", empty))


def adopt(incoming: DataFrame, local: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Incoming edits a reader takes over: of the paragraph as it is now, and newer than its own."""
    fresh = incoming.join(paragraphs.select("h", F.col("base_hash").alias("now")), "h").filter(F.col("base_hash").eqNullSafe(F.col("now"))).drop("now")
    mine = local.select("account_id", "book_id", "h", F.col("at").alias("mine"))
    return fresh.join(mine, ["account_id", "book_id", "h"], "left").filter(F.col("mine").isNull() | (F.col("at") > F.col("mine"))).drop("mine")


def live_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.filter(F.col("expires_at") > now)


def sweep(sessions: DataFrame, now: Column) -> DataFrame:
    """What is left after expired rows are removed; one that expires just now is neither live nor swept."""
    return sessions.filter(~(F.col("expires_at") < now))


def upsert(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key, the new one displacing the held (delete by key and append)."""
    return held.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
