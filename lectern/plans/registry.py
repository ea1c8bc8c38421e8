"""Registration of queries and their SQL, and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import table


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep


# --- inputs in Spark ------------------------------------------------------------------


def book(spark: SparkSession, sf_dir: str, paragraphs: Column | None = None, joined: str = "\n\n") -> DataFrame:
    """(doc, text): each chapter as one text, blank lines between its elements."""
    chapters = table(spark, sf_dir, "chapter").filter("paragraphs is not null")
    return chapters.select(F.col("chapter_id").alias("doc"), F.array_join(F.col("paragraphs") if paragraphs is None else paragraphs, joined).alias("text"))


def lines_of(texts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, line_no, line) of texts."""
    return texts.select("doc", *keep, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, edition_id, pos, text): the elements of every chapter; NULL elements are none."""
    chapters = table(spark, sf_dir, "chapter")
    return chapters.select(F.col("chapter_id").alias("doc"), "edition_id", "ch_idx", F.posexplode("paragraphs").alias("pos", "text")).filter("text is not null")


# --- the same in SQL --------------------------------------------------------------------

BOOK = "book as (select chapter_id as doc, array_to_string(paragraphs, chr(10) || chr(10)) as text from chapter where paragraphs is not null)"
LINES = "lines as (select doc, unnest(range(len(a))) as line_no, unnest(a) as line from (select doc, string_split(text, chr(10)) as a from book))"
PARAS = "paras as (select * from (select chapter_id as doc, edition_id, ch_idx, unnest(range(len(paragraphs))) as pos, unnest(paragraphs) as text from chapter) where text is not null)"
#: Macro-like pieces of SQL.
HASH = "substring(sha256({0}), 1, 16)"
STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def sql_hash(x: str) -> str:
    return HASH.format(x)


def sql_strip(x: str) -> str:
    return STRIP.format(x)
