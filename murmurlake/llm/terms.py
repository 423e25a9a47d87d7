"""Occurrences and record counts of every term, kept current by signed deltas.

A state folder holds four tables of signed rows, each in levels, one level for every change set:

* ``postings``: field, owner, term, d_occ, d_rows; the rows that put a term into a record, by hash bucket;
* ``counts``: field, term, d_total, d_owners, d_keys, by the same buckets; what queries read, summed up;
* ``owners``: field, owner, d_keys, by hash bucket of the owner; the terms a record has;
* ``records``: field, d_records; one row a field.

A change set is a table of rows with ``sign`` +1 (added) or -1 (deleted); a changed row is a deletion of
its old form and an addition of its new one. Only the change set is aggregated and only its level is
written, so what is written follows the change set, not the state. A term's owner count moves only where a
posting appears or vanishes: that is known from the earlier levels' postings of the same keys, of which
only the touched buckets are read. The first load is the change set that adds everything. ``compact`` sums
the levels into one and removes them; it runs by itself once there are ``MAX_LEVELS``. A level is written
beside the others and counts from when all of it is there, so a lost executor or a failed write leaves the
state before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stripped from both ends of a term (fixed value).
EDGE = "\"'`.,;:!?()[]{}<>«»•–—…“”‘’"
#: Characters with the Unicode property White_Space (fixed value).
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK_CLASS = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Buckets of the tables; choose as many as make a bucket's postings fit a task.
BUCKETS = 64
#: Levels from which on a change set also sums up the levels.
MAX_LEVELS = 8
#: Keys and signed columns of the state's tables.
TABLES = {
    "postings": (("field", "owner", "term"), ("d_occ", "d_rows")),
    "counts": (("field", "term"), ("d_total", "d_owners", "d_keys")),
    "owners": (("field", "owner"), ("d_keys",)),
    "records": (("field",), ("d_records",)),
}
#: The key whose hash is a row's bucket.
_BUCKET = {"postings": ("field", "term"), "counts": ("field", "term"), "owners": ("field", "owner")}


def words_of(text: Column) -> Column:
    """Terms of a running text: split at white space, edges stripped, lower-cased, empty ones dropped."""
    parts = F.transform(F.split(text, BLANK_CLASS), lambda w: F.lower(F.btrim(w, F.lit(EDGE))))
    return F.filter(parts, lambda w: w != "")


def whole_term(text: Column) -> Column:
    """The one term that a short text is: white space, then edges stripped, lower-cased; null if empty."""
    return F.nullif(F.lower(F.btrim(F.btrim(text, F.lit(BLANKS)), F.lit(EDGE))), F.lit(""))


def changes(postings: DataFrame) -> DataFrame:
    """Fold signed rows (field, owner, term, n, sign) to one per posting: d_occ and d_rows.

    Null terms are dropped; a null ``n`` counts 0 occurrences but is a row; a null owner has occurrences
    and is no record.
    """
    return (
        postings.filter(F.col("term").isNotNull())
        .groupBy("field", "owner", "term")
        .agg(F.sum(F.coalesce(F.col("n"), F.lit(0)) * F.col("sign")).alias("d_occ"), F.sum("sign").alias("d_rows"))
    )


class TermCounts:
    """Persistent counts in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, max_levels: int = MAX_LEVELS):
        self.spark, self.path, self.buckets, self.max_levels = spark, path.rstrip("/"), buckets, max_levels
        self.levels: list[int] = []
        self.made = 0

    def _read(self, name: str, levels: list[int], buckets: list[int] | None = None) -> DataFrame:
        keys, signed = TABLES[name]
        # with its schema, as a level may be empty
        ddl = ", ".join([*(f"{k} string" for k in keys), *(f"{c} bigint" for c in signed), *(["bucket int"] if name in _BUCKET else [])])
        paths = [f"{self.path}/level={n}/{name}" for n in levels]
        if not paths:
            return self.spark.createDataFrame([], ddl)
        df = self.spark.read.schema(ddl).parquet(*paths) if len(paths) == 1 else self._union(ddl, paths)
        return df if buckets is None else df.filter(F.col("bucket").isin(buckets))

    def _union(self, ddl: str, paths: list[str]) -> DataFrame:
        parts = [self.spark.read.schema(ddl).parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, parts)

    def _write(self, df: DataFrame, name: str, level: int) -> DataFrame:
        where = f"{self.path}/level={level}/{name}"
        if name in _BUCKET:
            bucket = F.pmod(F.xxhash64(*_BUCKET[name]), F.lit(self.buckets)).cast("int")
            # a bucket's rows are brought together, so that each has one file
            df.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(where)
        else:
            df.coalesce(1).write.mode("overwrite").parquet(where)
        return self._read(name, [level])

    def _summed(self, name: str, levels: list[int], buckets: list[int] | None = None) -> DataFrame:
        keys, signed = TABLES[name]
        rows = self._read(name, levels, buckets)
        # a level has each key once
        return rows.select(*keys, *signed) if len(levels) == 1 else rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in signed])

    def _known(self, fresh: DataFrame, name: str, column: str) -> DataFrame:
        """``fresh`` (a level's rows) with ``had``: what the earlier levels hold of ``column`` for the same keys."""
        if not self.levels:
            return fresh.withColumn("had", F.lit(0).cast("bigint"))
        keys, _ = TABLES[name]
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most as many as there are buckets
        wanted = fresh.select(*[F.col(k).alias(f"__{k}") for k in keys], F.lit(True).alias("__one"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        old = self._read(name, self.levels, touched).join(wanted, same, "left_semi").groupBy(*keys).agg(F.sum(column).alias("had"))
        old = old.select(*[F.col(k).alias(f"__{k}") for k in keys], "had")
        return fresh.join(old, same, "left").drop(*[f"__{k}" for k in keys]).withColumn("had", F.coalesce("had", F.lit(0)))

    def apply(self, signed: DataFrame) -> "TermCounts":
        """Take in a change set; columns field, owner, term, n, sign. Returns self."""
        level = self.made + 1
        fresh = self._write(changes(signed), "postings", level)
        rows = F.col("d_rows") + F.col("had")
        moves = self._known(fresh, "postings", "d_rows").withColumn("present", (rows > 0).cast("bigint") - (F.col("had") > 0).cast("bigint"))
        owned = F.when(F.col("owner").isNotNull(), F.col("present")).otherwise(0)
        per_term = moves.groupBy("field", "term").agg(F.sum("d_occ").alias("d_total"), F.sum(owned).alias("d_owners"), F.sum("present").alias("d_keys"))
        self._write(per_term, "counts", level)
        per_owner = moves.filter(F.col("owner").isNotNull()).groupBy("field", "owner").agg(F.sum("present").alias("d_keys")).filter("d_keys <> 0")
        owners = self._known(self._write(per_owner, "owners", level), "owners", "d_keys")
        came = (F.col("had") + F.col("d_keys") > 0).cast("bigint") - (F.col("had") > 0).cast("bigint")
        self._write(owners.groupBy("field").agg(F.sum(came).alias("d_records")), "records", level)
        self.made = level
        self.levels.append(level)
        if len(self.levels) >= self.max_levels:
            self.compact()
        return self

    def compact(self) -> "TermCounts":
        """Sum the levels into one, without rows that came to nothing, and remove them."""
        if len(self.levels) > 1:
            level, old = self.made + 1, self.levels
            for name, (_, signed) in TABLES.items():
                gone = reduce(lambda a, b: a & b, [F.col(c) == 0 for c in signed])
                self._write(self._summed(name, old).filter(~gone), name, level)
            self.made, self.levels = level, [level]
            jvm = self.spark.sparkContext._jvm
            for n in old:
                path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/level={n}")
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return self

    def counts(self) -> DataFrame:
        """field, term, total, owners of every term that any record has."""
        return self._summed("counts", self.levels).filter("d_keys > 0").select("field", "term", F.col("d_total").alias("total"), F.col("d_owners").alias("owners"))

    def records(self) -> DataFrame:
        """Per field the number of records with any term."""
        return self._summed("records", self.levels).select("field", F.col("d_records").alias("records"))


def marked(counts: DataFrame, records: DataFrame, rare_below: int = 3, common_share: float = 0.5) -> DataFrame:
    """Terms that are too rare (total below ``rare_below``) or too common (in more than ``common_share`` of
    the field's records) to be useful; a term that is both has two rows."""
    # one row per field
    rows = counts.join(F.broadcast(records), "field", "left")
    rare = F.when(F.col("total") < rare_below, F.lit("rare"))
    common = F.when(F.col("owners") > F.col("records") * common_share, F.lit("common"))
    return rows.select("field", "term", "total", "owners", "records", F.explode(F.array_compact(F.array(rare, common))).alias("mark"))
