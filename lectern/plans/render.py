"""The finished book as data: pairs and chapters, read back, its metrics, the shelf's records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.numbers import roman_text


def assemble(paragraphs: DataFrame, translations: DataFrame, published: DataFrame) -> DataFrame:
    """(book, pos, ch_idx, h, fr, en, pub): the flat pairs of books; a hash without text gives ''."""
    en = translations.groupBy("h").agg(F.max("value").alias("en"))
    pub = published.groupBy("h").agg(F.max("value").alias("pub"))
    rows = paragraphs.join(en, "h", "left").join(pub, "h", "left")
    return rows.select("book", "pos", "ch_idx", "h", F.col("text").alias("fr"), F.coalesce("en", F.lit("")).alias("en"), F.coalesce("pub", F.lit("")).alias("pub"))


def chapter_index(pairs: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book, ch_idx, pair, numeral, title, en_blank, pub_blank): where each headed chapter begins and which column has nothing in it."""
    n = pairs.groupBy("book", "ch_idx").agg(F.min("pos").alias("pair"), F.max(F.col("en") != "").alias("en"), F.max((F.col("en") != "") | (F.col("pub") != "")).alias("pub"))
    rows = chapters.filter("num is not null or title is not null").join(n, ["book", "ch_idx"])
    return rows.select("book", "ch_idx", "pair", roman_text(F.col("num")).alias("numeral"), "title", (~F.col("en")).alias("en_blank"), (~F.col("pub")).alias("pub_blank"))


def book_json(pairs: DataFrame) -> DataFrame:
    """(book, data): a book's pairs as one JSON text, '<' escaped so that it is safe inside a script."""
    per = pairs.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("pos", "ch_idx", "h", "fr", "en", "pub"))).alias("pairs"))
    return per.select("book", F.replace(F.to_json(F.struct("pairs")), F.lit("<"), F.lit("\\u003c")).alias("data"))


PAIRS = "pairs array<struct<pos:bigint,ch_idx:int,h:string,fr:string,en:string,pub:string>>"


def read_back(books: DataFrame) -> DataFrame:
    """The pairs of finished books: the inverse of ``book_json``."""
    return books.select("book", F.explode(F.from_json("data", PAIRS)["pairs"]).alias("p")).select("book", "p.*")


def finished_metrics(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """(book, paragraphs, translated, glossed, published): what a finished book says of itself."""
    glossed = units.filter(F.size("units") > 0).select("h").distinct().withColumn("g", F.lit(True))
    rows = pairs.join(glossed, "h", "left")
    return rows.groupBy("book").agg(F.count("*").alias("paragraphs"), F.count_if(F.trim("en") != "").alias("translated"), F.count_if("g").alias("glossed"), F.max(F.col("pub") != "").alias("published"))


def catalogue(cards: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(joined, missing): cards with their book by slug; every card without one is an error row."""
    return cards.join(books, "slug"), cards.join(books, "slug", "left_anti")


def spreads(paragraphs: DataFrame, budget: int = 1200, steps: int = 12) -> DataFrame:
    """(book, spread, pos, start, end): paragraphs laid out on spreads of a character budget.

    Whole paragraphs while they fit; one that does not is cut at the fraction that twelve
    halvings find for the room left, moved to a word's end. The fold runs over one book's
    array; the fit predicate (characters) is this engine's own.
    """
    per = paragraphs.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("a"))
    cells = "array<struct<spread:int,pos:bigint,start:int,end:int>>"
    start = F.struct(F.array().cast(cells).alias("out"), F.lit(0).alias("spread"), F.lit(0).alias("used"))

    def place(s: Column, p: Column) -> Column:
        n = F.length(p["text"])
        room = F.lit(budget) - s["used"]
        fits = n <= room
        # a long paragraph: the first piece fills the room, whole spreads follow, the rest opens the last
        fraction = F.floor(F.greatest(room, F.lit(0)) / n * (1 << steps)) / (1 << steps)
        at = F.floor(n * fraction).cast("int")
        space = F.locate(" ", F.substr(p["text"], at + 1))
        cut = F.when((room < budget // 10) | (at == 0), 0).otherwise(F.least(n, F.when(space > 0, at + space).otherwise(n)))
        rest = n - cut
        more = F.ceil(rest / budget).cast("int")
        first = F.when(cut > 0, F.array(F.struct(s["spread"].alias("spread"), p["pos"].alias("pos"), F.lit(0).alias("start"), cut.cast("int").alias("end")))).otherwise(F.array().cast(cells))
        pages = F.transform(F.when(more > 0, F.sequence(F.lit(1), more)).otherwise(F.array().cast("array<int>")), lambda k: F.struct((s["spread"] + k).alias("spread"), p["pos"].alias("pos"), (cut + (k - 1) * budget).cast("int").alias("start"), F.least(n, cut + k * budget).cast("int").alias("end")))
        whole = F.array(F.struct(s["spread"].alias("spread"), p["pos"].alias("pos"), F.lit(0).alias("start"), n.alias("end")))
        out = F.when(fits, F.concat(s["out"], whole)).otherwise(F.concat(s["out"], first, pages))
        return F.struct(out.alias("out"), F.when(fits, s["spread"]).otherwise(s["spread"] + more).alias("spread"), F.when(fits, s["used"] + n).otherwise(rest - (F.greatest(more, F.lit(1)) - 1) * budget).cast("int").alias("used"))

    return per.select("book", F.explode(F.aggregate("a", start, place, lambda s: s["out"])).alias("c")).select("book", "c.*")


def wanted_formats(books: DataFrame, formats: list[str], carried: DataFrame, remake: bool = False) -> DataFrame:
    """(slug, format): files to make: every format a book does not carry, or all of them."""
    want = books.select("slug", F.explode(F.array(*[F.lit(f) for f in formats])).alias("format"))
    return want if remake else want.join(carried.select("slug", "format").distinct(), ["slug", "format"], "left_anti")


def published_note(method: Column, share: Column, unmatched: Column, cut: Column) -> Column:
    """What a reader is told of the published column."""
    return (
        F.when(share < 0.7, "much of this edition found no counterpart")
        .when(cut.isNotNull() & (cut != ""), "paragraphs cut to the other edition's shape")
        .when(method == "proportional", "set beside by length")
        .when(unmatched > 0, "some paragraphs have no counterpart")
        .otherwise("")
    )


def edition_summary(editions: DataFrame, chapters: DataFrame) -> DataFrame:
    """(edition_id, chapters, paragraphs, chars): counted, with the stated figures where nothing can be."""
    n = chapters.groupBy("edition_id").agg(F.count("*").alias("c"), F.sum(F.size("paragraphs")).alias("p"), F.sum(F.aggregate("paragraphs", F.lit(0), lambda s, x: s + F.coalesce(F.length(x), F.lit(0)))).alias("k"))
    return editions.join(n, "edition_id", "left").select("edition_id", F.coalesce("c", "chapters").cast("bigint").alias("chapters"), F.coalesce("p", "paragraphs").cast("bigint").alias("paragraphs"), F.coalesce("k", "chars").cast("bigint").alias("chars"))


def shelf_lookup(editions: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Editions of which any named column holds its words, whatever the case; NULL holds none."""
    hit = F.lit(False)
    for column, words in wanted.items():
        hit = hit | F.lower(F.coalesce(F.col(column), F.lit(""))).contains(words.lower())
    return editions.filter(hit)


def probe_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """(book, n, m, alike): page counts of two resolved sides without their chapters."""
    a, b = left.groupBy("book").agg(F.count("*").alias("n")), right.groupBy("book").agg(F.count("*").alias("m"))
    both = a.join(b, "book", "full").na.fill(0, ["n", "m"])
    return both.withColumn("alike", F.least("n", "m") >= F.greatest("n", "m") * 0.8)


def one_page(groups: DataFrame, page: int) -> DataFrame:
    """The rows of one packed page of each book, round again past its end."""
    n = groups.groupBy("book").agg((F.max("group") + 1).alias("n"))
    return groups.join(n, "book").filter(F.col("group") == F.pmod(F.lit(page), F.col("n"))).drop("n")


def openings(rows: DataFrame, n: int = 60, chars: int = 1200) -> DataFrame:
    """The first ``n`` paragraphs of each book, cut to ``chars``: what the opening finder compares."""
    k = F.row_number().over(Window.partitionBy("book").orderBy("pos"))
    return rows.withColumn("k", k).filter(F.col("k") <= n).select("book", (F.col("k") - 1).alias("pos"), F.left("text", F.lit(chars)).alias("text"))
