"""Merge-on-read tables: rows by ``id`` in bucketed base files, and one delta of upserts and tombstones per batch.

A batch reads only the buckets of the ids it names and writes only its own rows; readers put the newest delta row of an
id in place of its base row. After ``compact_after`` deltas the buckets they touch are rewritten, the others keep their
files. A commit is a folder of one row that names all files of a state; it counts once Spark has marked it as
complete, so what a failed run left behind is never seen, and a batch that is run again is skipped or done anew.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, COMPACT_AFTER = 16, 4
#: Commits whose files are kept, for readers that have begun.
KEEP = 3
_COMMIT = "batch long, mark long, buckets int, schema string, files map<int,string>, deltas array<string>"


@dataclass(frozen=True)
class State:
    """What a commit says: the last batch, a number that batches hand on (a high-water mark), and the files."""

    batch: int
    mark: int
    buckets: int
    schema: T.StructType
    files: dict[int, str] = field(default_factory=dict)
    deltas: tuple[str, ...] = ()


def path_of(spark: SparkSession, path: str):
    """(file system, path) of the store that holds ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str, done: bool = False) -> list[str]:
    """Names in a folder, in order; with ``done``, of complete folders only. An absent folder has none, a failing store is an error."""
    fs, p = path_of(spark, path)
    if not fs.exists(p):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    return [n for n in names if not done or fs.exists(path_of(spark, f"{path}/{n}/_SUCCESS")[1])]


def bucket_of(ids: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(buckets)).cast("int")


def _commits(spark: SparkSession, root: str) -> list[str]:
    return _names(spark, f"{root}/commits", done=True)


def _read_commit(spark: SparkSession, root: str, name: str) -> State:
    r = spark.read.schema(_COMMIT).parquet(f"{root}/commits/{name}").first()
    return State(r["batch"], r["mark"], r["buckets"], T.StructType.fromJson(json.loads(r["schema"])), dict(r["files"]), tuple(r["deltas"]))


def state(spark: SparkSession, root: str) -> State | None:
    """The newest committed state; None if there is none."""
    names = _commits(spark, root)
    return _read_commit(spark, root, names[-1]) if names else None


def _commit(spark: SparkSession, root: str, st: State, compacted: bool = False) -> State:
    row = [(st.batch, st.mark, st.buckets, st.schema.json(), st.files, list(st.deltas))]
    spark.createDataFrame(row, _COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/{st.batch + 1:010d}-{int(compacted)}")
    _expire(spark, root)
    return st


def _expire(spark: SparkSession, root: str) -> None:
    """Delete commits before the last KEEP, and files that only they name."""
    names = _commits(spark, root)
    if len(names) <= KEEP:
        return
    named = lambda st: {*st.files.values(), *st.deltas}
    kept = set().union(*(named(_read_commit(spark, root, n)) for n in names[-KEEP:]))
    for n in names[:-KEEP]:
        for path in [*(named(_read_commit(spark, root, n)) - kept), f"{root}/commits/{n}"]:
            fs, p = path_of(spark, path)
            fs.delete(p, True)


def _write(rows: DataFrame, path: str, buckets: int) -> dict[int, str]:
    """Write rows by bucket (a large bucket in several files); returns the folders written."""
    rows.withColumn("_bucket", bucket_of("id", buckets)).hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)
    found = [n for n in _names(rows.sparkSession, path) if n.startswith("_bucket=")]
    return {int(n.split("=")[1]): f"{path}/{n}" for n in found}


def create(spark: SparkSession, root: str, rows: DataFrame, mark: int | None = None, buckets: int = BUCKETS) -> State:
    """Start a table from ``rows`` (unique, not null ``id``); nothing is done if it has a commit. ``mark`` is the largest id unless given."""
    st = state(spark, root)
    if st is not None:
        return st
    files = _write(rows, f"{root}/base/start", buckets)
    if mark is None:
        mark = rows.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return _commit(spark, root, State(-1, mark, buckets, rows.schema, files))


def _deltas(spark: SparkSession, root: str, st: State) -> DataFrame:
    """All rows of the deltas, with ``_deleted`` and the folders' ``_batch`` and ``_bucket``."""
    schema = T.StructType([*st.schema.fields, T.StructField("_deleted", T.BooleanType()), T.StructField("_batch", T.LongType()), T.StructField("_bucket", T.IntegerType())])
    return spark.read.schema(schema).option("basePath", f"{root}/delta").parquet(*st.deltas)


def read(spark: SparkSession, root: str, only: list[int] | None = None, at: State | None = None) -> DataFrame:
    """The table's rows, of all buckets or some: base rows without a newer version, and the newest live versions.

    The ids of the deltas stay in the tasks: a merge join, however small their files look."""
    st = at or state(spark, root)
    paths = [p for b, p in st.files.items() if only is None or b in only]
    base = spark.read.schema(st.schema).parquet(*paths) if paths else spark.createDataFrame([], st.schema)
    if not st.deltas:
        return base
    new = _deltas(spark, root, st)
    new = new if only is None else new.where(F.col("_bucket").isin(only))
    newest = new.groupBy("id").agg(F.max_by(F.struct(*new.columns), "_batch").alias("r")).select("r.*")
    return base.join(newest.select("id").hint("merge"), "id", "left_anti").unionByName(newest.where("not _deleted").select(*base.columns))


def lookup(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """The rows of the given ids; only their buckets are read."""
    st = state(spark, root)
    touched = [r["b"] for r in ids.select(bucket_of("id", st.buckets).alias("b")).distinct().collect()]  # at most the buckets
    return read(spark, root, touched, st).join(ids.select("id").distinct().hint("merge"), "id", "left_semi")


def merge(spark: SparkSession, root: str, batch_id: int, upserts: DataFrame, deletes: DataFrame | None = None, mark: int | None = None,
          compact_after: int = COMPACT_AFTER) -> State:
    """Commit a batch: ``upserts`` (whole rows, an id once) and ``deletes`` (id). A batch up to the last committed one is skipped."""
    st = state(spark, root)
    if batch_id <= st.batch:
        return st
    rows = upserts.select(*st.schema.names).withColumn("_deleted", F.lit(False))
    if deletes is not None:
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in st.schema.fields if f.name != "id"]
        rows = rows.unionByName(deletes.select("id", *blank, F.lit(True).alias("_deleted")))
    delta = f"{root}/delta/_batch={batch_id}"
    _write(rows, delta, st.buckets)
    st = _commit(spark, root, State(batch_id, st.mark if mark is None else mark, st.buckets, st.schema, st.files, (*st.deltas, delta)))
    return compact(spark, root) if len(st.deltas) >= compact_after else st


def compact(spark: SparkSession, root: str) -> State:
    """Rewrite the buckets that deltas touch; the others keep their files."""
    st = state(spark, root)
    if not st.deltas:
        return st
    touched = [r["_bucket"] for r in _deltas(spark, root, st).select("_bucket").distinct().collect()]
    made = _write(read(spark, root, touched, st), f"{root}/base/{st.batch:010d}", st.buckets)
    files = {b: p for b, p in st.files.items() if b not in touched} | made
    return _commit(spark, root, State(st.batch, st.mark, st.buckets, st.schema, files), compacted=True)


def append_once(rows: DataFrame, root: str, batch_id: int) -> None:
    """The log rows of a batch, in a folder of its own; a run again writes them anew."""
    rows.write.mode("overwrite").parquet(f"{root}/log/batch={batch_id}")


def read_log(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The log rows of all committed batches."""
    st = state(spark, root)
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    if not _names(spark, f"{root}/log"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(whole).parquet(f"{root}/log").where(F.col("batch") <= st.batch).drop("batch")
