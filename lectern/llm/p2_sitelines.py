"""Lines repeated across one site's documents.

Method: line counts are kept per source as increments. A new partition of chapters is
reduced to its own counts (one a chapter and line, combined before the shuffle), summed with
the earlier counts of just its lines, and the lines that cross the threshold with it are
found; only chapters that hold a newly crossed line are rebuilt. Nothing old is rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import table, work_path

MIN_CHAPTERS, MIN_LETTERS = 6, 12


def line_key(line: Column) -> Column:
    """What makes two lines the same: their letters, whatever case, spacing, punctuation and digits."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}\p{M}]+", "")


def chapter_lines(chapters: DataFrame) -> DataFrame:
    """(chapter_id, edition_id, lines): the countable lines of a chapter with position and key hash.

    NULL paragraphs hold no lines. The text itself goes no further than this projection.
    """

    def lines(p: Column, i: Column) -> Column:
        keys = F.transform(F.split(p, "\n"), lambda line, j: F.struct(i.cast("int").alias("p"), j.cast("int").alias("l"), line_key(line).alias("key")))
        long = F.filter(keys, lambda x: F.length(x["key"]) >= MIN_LETTERS)
        return F.transform(long, lambda x: F.struct(x["p"].alias("p"), x["l"].alias("l"), F.xxhash64(x["key"]).alias("k")))

    found = F.flatten(F.transform(F.filter(F.transform("paragraphs", lambda p, i: F.struct(p.alias("t"), i.alias("i"))), lambda x: x["t"].isNotNull()), lambda x: lines(x["t"], x["i"])))
    return chapters.select("chapter_id", "edition_id", found.alias("lines")).filter(F.size("lines") > 0)


class SiteLines:
    """Per-source line counts in ``path``, merged a partition at a time."""

    def __init__(self, spark: SparkSession, path: str, min_chapters: int = MIN_CHAPTERS):
        self.spark, self.path, self.min_chapters, self.parts = spark, path, min_chapters, 0

    def _all(self, kind: str, upto: int) -> list[str]:
        return [f"{self.path}/{kind}/{n:06d}" for n in range(upto)]

    def merge(self, lines: DataFrame) -> None:
        """Merge (chapter_id, source, lines). A chapter delivered before counts no second time.

        Without source a line belongs to no site and is not counted.
        """
        n, here = self.parts, f"{self.parts:06d}"
        lines = lines.filter(F.col("source").isNotNull()).select("chapter_id", "source", "lines")
        if n:
            lines = lines.join(self.spark.read.parquet(*self._all("lines", n)).select("chapter_id"), "chapter_id", "left_anti")
        lines.write.parquet(f"{self.path}/lines/{here}")
        lines = self.spark.read.parquet(f"{self.path}/lines/{here}")
        own = lines.select("source", F.explode(F.array_distinct(F.transform("lines", lambda x: x["k"]))).alias("k"))
        own.groupBy("source", "k").agg(F.count("*").alias("n")).write.parquet(f"{self.path}/counts/{here}")
        own = self.spark.read.parquet(f"{self.path}/counts/{here}")
        if n:
            before = self.spark.read.parquet(*self._all("counts", n)).join(own.select("source", "k"), ["source", "k"], "left_semi")
            total = own.withColumn("old", F.lit(0).cast("bigint")).unionByName(before.select("source", "k", F.lit(0).cast("bigint").alias("n"), F.col("n").alias("old")))
            total = total.groupBy("source", "k").agg(F.sum("n").alias("n"), F.sum("old").alias("old"))
        else:
            total = own.withColumn("old", F.lit(0).cast("bigint"))
        crossed = total.filter((F.col("old") < self.min_chapters) & (F.col("old") + F.col("n") >= self.min_chapters))
        crossed.select("source", "k").write.parquet(f"{self.path}/crossed/{here}")
        self.parts += 1

    def removed(self, part: int) -> DataFrame:
        """(chapter_id, p_idx, line_idx) that partition ``part`` made known: repeated lines of
        its own chapters, and in earlier chapters the lines that crossed with it."""
        new = self._postings([part]).join(self.spark.read.parquet(*self._all("crossed", part + 1)), ["source", "k"], "left_semi")
        if part:
            crossed = self.spark.read.parquet(f"{self.path}/crossed/{part:06d}")
            new = new.unionByName(self._postings(range(part)).join(crossed, ["source", "k"], "left_semi"))
        return new.select("chapter_id", "p_idx", "line_idx")

    def _postings(self, parts) -> DataFrame:
        lines = self.spark.read.parquet(*[f"{self.path}/lines/{n:06d}" for n in parts])
        return lines.select("source", "chapter_id", F.explode("lines").alias("x")).select("source", "chapter_id", F.col("x.k").alias("k"), F.col("x.p").cast("bigint").alias("p_idx"), F.col("x.l").cast("bigint").alias("line_idx"))


def repeated_lines(chapters: DataFrame, editions: DataFrame, partitions: int = 3, min_chapters: int = MIN_CHAPTERS) -> DataFrame:
    """(chapter_id, p_idx, line_idx) of the lines repeated in ``min_chapters`` chapters of a source.

    The chapters are merged as ``partitions`` deltas by chapter_id; the result is the same for
    any split. The text is read once: the lines are extracted to hashes before any shuffle.
    Chapters without id are left out; a repeated chapter_id is one chapter, its first text by hash.
    """
    spark = chapters.sparkSession
    path = work_path(spark, "sitelines")
    lines = chapter_lines(chapters.filter("chapter_id is not null"))
    sources = editions.filter("edition_id is not null").groupBy("edition_id").agg(F.min("source").alias("source"))
    lines = lines.join(sources, "edition_id").select("chapter_id", "source", "lines")
    lines = lines.withColumn("delta", F.pmod(F.xxhash64("chapter_id"), F.lit(partitions)).cast("int"))
    lines.write.partitionBy("delta").parquet(f"{path}/input")
    whole = spark.read.schema(lines.schema).parquet(f"{path}/input")
    site = SiteLines(spark, f"{path}/state", min_chapters)
    for n in range(partitions):
        part = whole.filter(F.col("delta") == n)
        first = F.min_by(F.struct("source", "lines"), F.xxhash64("source", "lines")).alias("c")
        site.merge(part.groupBy("chapter_id").agg(first).select("chapter_id", "c.source", "c.lines"))
    out = site.removed(0)
    for n in range(1, partitions):
        out = out.unionByName(site.removed(n))
    return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a chapter that is repeated excessively in its source."""
    return repeated_lines(table(spark, sf_dir, "chapter"), table(spark, sf_dir, "edition"))


def p2_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chapter without its source's repeated lines; an element left empty goes, other text stays as it is."""
    chapters = table(spark, sf_dir, "chapter")
    gone = repeated_lines(chapters, table(spark, sf_dir, "edition"))
    gone = gone.groupBy("chapter_id").agg(F.collect_set(F.struct(F.col("p_idx").cast("int").alias("p"), F.col("line_idx").cast("int").alias("l"))).alias("gone"))

    def kept(p: Column, i: Column) -> Column:
        lines = F.transform(F.split(p, "\n"), lambda line, j: F.struct(line.alias("t"), F.struct(i.cast("int").alias("p"), j.cast("int").alias("l")).alias("at")))
        left = F.filter(lines, lambda x: ~F.array_contains("gone", x["at"]))
        return F.when(F.size(left) == F.size(lines), p).when(F.size(left) > 0, F.array_join(F.transform(left, lambda x: x["t"]), "\n"))

    rebuilt = F.filter(F.transform("paragraphs", kept), lambda p: p.isNotNull())
    out = chapters.select("chapter_id", "paragraphs").join(gone, "chapter_id", "left")
    return out.select("chapter_id", F.when(F.col("gone").isNull(), F.col("paragraphs")).otherwise(rebuilt).alias("paragraphs"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))


P2_SQL = r"""
with e as (select edition_id, min(source) as source from edition group by 1),
p as (
  select chapter_id, edition_id, unnest(paragraphs) as t, unnest(range(len(paragraphs))) as p_idx from chapter
), l as (
  select chapter_id, edition_id, p_idx, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as line_idx from p where t is not null
), k as (
  select chapter_id, source, p_idx, line_idx, regexp_replace(lower(line), '[^\p{L}\p{M}]+', '', 'g') as key from l join e using (edition_id) where source is not null
), hot as (
  select source, key from k where length(key) >= 12 group by all having count(distinct chapter_id) >= 6
)
select chapter_id, p_idx, line_idx from k semi join hot using (source, key)
"""
