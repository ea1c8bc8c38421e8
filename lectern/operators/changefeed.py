"""Applying a change feed with delete vectors (merge on read).

The table is a set of immutable parquet files. A commit reduces its changes to one image a
key, looks the keys up in an index from key to (file, row), sets the superseded rows' bits
in a bitmap per file, and appends the new images; nothing written is ever rewritten. A read
filters the rows whose bit is set. Images carry the order (instant, arrival), so late and
repeated changes give the same state in whatever commits they come.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import Commits, table, work_path, written_over

HAS_OFFSET = r"(?i)(Z|[+-]\d{2}:?\d{2})\s*$"


def instant_micros(text: Column) -> Column:
    """Microseconds since the epoch of an ISO text; without offset it is UTC, unreadable gives NULL."""
    trimmed = F.trim(text)
    zoned = F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(trimmed, F.lit("T00:00:00Z"))).when(trimmed.rlike(HAS_OFFSET), trimmed).otherwise(F.concat(trimmed, F.lit("Z")))
    return F.unix_micros(zoned.try_cast("timestamp"))


def first_deliveries(changes: DataFrame, ident: str = "change_id", arrival: str = "arrival") -> DataFrame:
    """One row per ``ident``: its first arrival. The aggregate combines before its shuffle."""
    rest = [c for c in changes.columns if c not in (ident, arrival)]
    packed = F.min(F.struct(F.col(arrival), F.struct(*rest).alias("r"))).alias("m")
    return changes.groupBy(ident).agg(packed).select(ident, F.col("m")[arrival].alias(arrival), *[F.col("m.r")[c].alias(c) for c in rest])


class DeleteVectorTable:
    """A keyed table of images; the image with the greatest order of a key is live.

    ``keys`` name the key columns (none may be NULL), ``order`` the columns that rank the
    images of a key, greatest last. An image that is not above the live one is dropped, so
    commits may be late, repeated or empty. The table lives in ``path``: a second instance goes
    on where the first one stopped, and a commit that failed is written over by the next try.
    The index lies in ``buckets`` by key hash; a commit reads only the buckets of its own keys.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path, list(keys), list(order), buckets
        self.done = Commits(spark, path)

    @property
    def commits(self) -> int:
        return len(self.done)

    def _parts(self, kind: str) -> list[str]:
        return [f"{self.path}/{kind}/{n:06d}" for n in range(self.commits)]

    def _bucket(self, keys: Sequence[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _put(self, rows: DataFrame, kind: str, keys: Sequence[str]) -> None:
        """Write a commit's rows by bucket; rows of another try of the same commit go."""
        rows = rows.withColumn("bucket", self._bucket(keys)).repartition("bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}/commit={self.commits}")

    def _held(self, rows: DataFrame, kind: str, keys: Sequence[str], columns: Sequence[str], more: str = "") -> DataFrame:
        """The committed rows of a kind in the buckets that the keys of ``rows`` fall into (at most ``buckets``)."""
        touched = [r.b for r in rows.select(self._bucket(keys).alias("b")).distinct().collect()]
        schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns] + [more] * bool(more) + ["commit int", "bucket int"])
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")
        return stored.filter((F.col("commit") < self.commits) & F.col("bucket").isin(*touched))

    def unseen(self, rows: DataFrame, ident: str) -> DataFrame:
        """``rows`` without those whose ``ident`` an earlier commit recorded."""
        return rows.join(self._held(rows, "seen", [ident], [ident]).select(ident), ident, "left_anti") if self.commits else rows

    def apply(self, images: DataFrame, seen: DataFrame | None = None, label: str = "") -> None:
        """Commit images: supersede, then append. Columns of ``images`` must stay the same over commits.

        ``seen``, one column of ids, is recorded with the commit for ``unseen``.
        """
        rest = [c for c in images.columns if c not in (*self.keys, *self.order)]
        best = F.max(F.struct(*self.order, *rest)).alias("i")
        new = images.groupBy(*self.keys).agg(best).select(*self.keys, *[F.col("i")[c].alias(c) for c in (*self.order, *rest)])
        here = f"{self.commits:06d}"
        if self.commits:
            new = written_over(new, f"{self.path}/new")
            held = self._held(new, "index", self.keys, [*self.keys, *self.order], "file string, pos bigint")
            held = held.groupBy(*self.keys).agg(F.max(F.struct(*self.order, "file", "pos")).alias("held"))
            new = new.join(held, self.keys, "left")
            above = F.struct(*[F.col(c) for c in self.order]) > F.struct(*[F.col("held")[c].alias(c) for c in self.order])
            new = new.filter(F.col("held").isNull() | above)
            new = new.withColumns({"old_file": F.col("held.file"), "old_pos": F.col("held.pos")}).drop("held")
        else:
            new = new.withColumns({"old_file": F.lit(None).cast("string"), "old_pos": F.lit(None).cast("bigint")})
        new.write.mode("overwrite").parquet(f"{self.path}/data/{here}")
        added = self.spark.read.parquet(f"{self.path}/data/{here}")
        at = F.concat_ws("/", F.lit(here), F.col("_metadata.file_name"))
        self._put(added.select(*self.keys, *self.order, at.alias("file"), F.col("_metadata.row_index").alias("pos")), "index", self.keys)
        gone = added.filter(F.col("old_file").isNotNull()).select(F.col("old_file").alias("file"), (F.col("old_pos") + 1).alias("n"))
        bits = gone.groupBy("file", F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))
        bits.write.mode("overwrite").parquet(f"{self.path}/gone/{here}")
        if seen is not None:
            self._put(seen, "seen", seen.columns)
        self.done.mark(label)

    def vectors(self) -> DataFrame:
        """(file, bucket, bits): the deleted rows of each file in buckets of 32768 rows."""
        gone = self.spark.read.parquet(*self._parts("gone"))
        return gone.groupBy("file", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def read(self) -> DataFrame:
        """The live images."""
        data = self.spark.read.parquet(*self._parts("data")).drop("old_file", "old_pos")
        part = F.regexp_extract(F.col("_metadata.file_path"), r"/data/(\d+)/[^/]+$", 1)
        n = F.col("_metadata.row_index") + 1
        data = data.select("*", F.concat_ws("/", part, F.col("_metadata.file_name")).alias("file"), F.bitmap_bucket_number(n).alias("bucket"), F.bitmap_bit_position(n).alias("bit"))
        data = data.join(self.vectors(), ["file", "bucket"], "left")
        byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
        dead = F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")), F.lit(0)) == 1
        return data.filter(~dead).drop("file", "bucket", "bit", "bits")


def shelf_images(changes: DataFrame) -> DataFrame:
    """Images of shelf changes, one key space for three facts:

    'edit' the last change of an edit (a delete stays as a mark), 'entry' the last entry
    change with a position within 0 to 1, 'drop' the last delete of an entry.
    Rows without instant, arrival, known op or entity, account or book are no changes and
    are left out; an edit without ``h`` has the key ''.
    """
    op, at = F.lower(F.trim("op")), instant_micros(F.col("updated_at"))
    entity = F.lower(F.trim("entity"))
    kind = (
        F.when(entity == "edit", "edit")
        .when((entity == "entry") & (op == "delete"), "drop")
        .when((entity == "entry") & F.col("position_frac").between(0, 1) & ~F.isnan("position_frac"), "entry")
    )
    h = F.when(entity == "edit", F.coalesce("h", F.lit(""))).otherwise("")
    out = changes.select(kind.alias("kind"), "account_id", "book_id", h.alias("h"), at.alias("at"), "arrival", "change_id", (op == "delete").alias("gone"), "text", "position_h", "position_frac")
    return out.filter(kind.isNotNull() & op.isin("insert", "update", "delete") & at.isNotNull() & F.col("arrival").isNotNull() & F.col("account_id").isNotNull() & F.col("book_id").isNotNull())


def shelf_state(images: DataFrame) -> DataFrame:
    """Shelf rows from live images: what came after the last delete of its entry."""
    order = F.struct("at", "arrival")
    drops = images.filter("kind = 'drop'").select("account_id", "book_id", order.alias("dropped"))
    kept = images.filter("kind <> 'drop' and not gone").withColumn("done", order)
    kept = kept.join(drops, ["account_id", "book_id"], "left").filter(F.col("dropped").isNull() | (F.col("done") > F.col("dropped")))
    return kept.select(F.col("kind").alias("entity"), "account_id", "book_id", "h", "change_id", "text", "position_h", "position_frac")


def apply_feed(changes: DataFrame, commits: int = 3) -> DataFrame:
    """The shelf after a feed, applied in ``commits`` parts by arrival through delete vectors.

    Repeated deliveries count once, at the first arrival, also over commits; rows without
    change_id can't be told apart and are left out. An empty feed gives an empty shelf.
    """
    changes = changes.filter(F.col("change_id").isNotNull())
    store = DeleteVectorTable(changes.sparkSession, work_path(changes.sparkSession, "shelf"), ["kind", "account_id", "book_id", "h"], ["at", "arrival"])
    cuts = changes.approxQuantile("arrival", [k / commits for k in range(1, commits)], 0.01) if commits > 1 else []
    bounds = [None, *sorted(set(cuts)), None]
    for low, high in zip(bounds, bounds[1:]):
        part = changes
        if low is not None:
            part = part.filter(F.col("arrival") > low)
        if high is not None:
            part = part.filter(F.col("arrival") <= high)
        deliver(store, part)
    return shelf_state(store.read())


def deliver(store: DeleteVectorTable, changes: DataFrame, label: str = "") -> None:
    """Commit shelf changes to a store, each change_id once over all commits: at its first arrival.

    A label that a commit already bears is that commit delivered again, and does nothing. Rows
    without change_id can't be told apart and are left out.
    """
    if label and label in store.done.labels:
        return
    fresh = store.unseen(first_deliveries(changes.filter(F.col("change_id").isNotNull())), "change_id")
    fresh = written_over(fresh, f"{store.path}/delivered")
    store.apply(shelf_images(fresh), fresh.select("change_id"), label)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every shelf: the change whose values hold for each key (an entry that no
    change gave a position since its last delete has none and gives no row)."""
    return apply_feed(table(spark, sf_dir, "shelf_change")).select("entity", "account_id", "book_id", "h", "change_id")


def p6_shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of every shelf: corrected texts and reading positions."""
    return apply_feed(table(spark, sf_dir, "shelf_change"))


P6_SQL = r"""
with once as (
  select * from (select *, row_number() over (partition by change_id order by arrival) as rn from shelf_change) where rn = 1
), c as (
  select lower(trim(op)) as op, lower(trim(entity)) as entity, account_id, book_id, h, change_id, arrival, text, position_h, position_frac,
    cast(case when regexp_matches(trim(updated_at), '(Z|[+-]\d{2}:?\d{2})$') then trim(updated_at) else trim(updated_at) || 'Z' end as timestamptz) as ts
  from once
), dropped as (
  select account_id, book_id, max(row(ts, arrival)) as d from c where entity = 'entry' and op = 'delete' group by all
), edits as (
  select 'edit' as entity, account_id, book_id, h, arg_max(row(change_id, op, text), row(ts, arrival)) as v, max(row(ts, arrival)) as o from c where entity = 'edit' group by all
), entries as (
  select 'entry' as entity, account_id, book_id, '' as h, arg_max(row(change_id, op, text), row(ts, arrival)) as v, max(row(ts, arrival)) as o,
    arg_max(row(position_h, position_frac), row(ts, arrival)) as p
  from c where entity = 'entry' and op <> 'delete' and position_frac between 0 and 1 group by all
), alive as (
  select entity, account_id, book_id, h, v, o, null as p from edits where v[2] <> 'delete'
  union all select entity, account_id, book_id, h, v, o, p from entries
)
select a.entity, a.account_id, a.book_id, a.h, a.v[1] as change_id{extra}
from alive a left join dropped d on a.account_id = d.account_id and a.book_id = d.book_id
where d.d is null or a.o > d.d
"""


def queries() -> dict:
    return {"p6_found": p6_found, "p6_shelf": p6_shelf}


def oracle_sql() -> dict:
    return {"p6_found": P6_SQL.replace("{extra}", "")}
