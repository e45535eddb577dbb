"""Reading tables, and tables kept on the shared folder."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The scopes that this thread is in, each the paths of its tables.
_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())
#: Settings under which tables that Python workers make are written: texts are large, workers small.
_ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most 500 rows and 4 MB for what is executed meanwhile; the caller's settings come back."""
    before = {key: spark.conf.get(key, None) for key in _ARROW}
    try:
        for key, value in _ARROW.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only where none is set and all runs on this machine, as in tests, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='keyloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/keyloom/{tag}-{uuid.uuid4().hex[:12]}"


def _written(df: DataFrame, tag: str, scopes: tuple[list[str], ...]) -> DataFrame:
    spark = df.sparkSession
    path = new_path(spark, tag)
    if scopes:
        scopes[-1].append(path)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read from there: lost executors cost no more than their own tasks. The table
    goes with the scope it was written in."""
    return _written(df, tag, _scopes.get())


def lasting(df: DataFrame, tag: str) -> DataFrame:
    """As keep(), for a result: the table stays beyond the scope it was written in."""
    return _written(df, tag, _scopes.get()[:-1])


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope whose tables are deleted at its end; what leaves it must read none but lasting() ones."""
    token = _scopes.set((*_scopes.get(), paths := []))
    try:
        yield
    finally:
        _scopes.reset(token)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def release() -> None:
    """Gives a Python worker's unused memory back: workers are reused, and what one stage held weighs on the next."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable) -> Callable:
    """run over the batches of a task, then release()."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def shrink_driver(spark: SparkSession) -> None:
    """Lets the driver collect its garbage and give unused memory back; shuffles that nothing names any more go with it."""
    release()
    spark._jvm.System.gc()


def shrink_heaps(spark: SparkSession) -> None:
    """Lets every executor collect its garbage and give unused heap back, which it keeps otherwise: for stages of a long
    job that hand over from JVM work to Python workers. One task a slot; results don't depend on it."""
    shrink_driver(spark)
    slots = max(2, spark.sparkContext.defaultParallelism)
    spark.range(0, slots, 1, slots).select(F.call_function("reflect", F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def private(df: DataFrame, *wanted: str) -> tuple[DataFrame, dict[str, str]]:
    """df under names of this package's own but for the wanted columns, so that no other column's name can clash with
    those of an operator; and df's names by the new ones, in order."""
    lower = {w.lower(): w for w in wanted}
    names = {lower.get(c.lower(), f"own_column_{k}"): c for k, c in enumerate(df.columns)}
    return df.toDF(*names), names


def row_key():
    """A hash of a document's id and text: rows that repeat both are one document, others with its id are not."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


#: Rows of a table of decisions, of bounded width, up to which it is broadcast (a few MB).
SMALL_ROWS = 200_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the documents of gone(doc_id, row_key). A gone of at most SMALL_ROWS rows is broadcast; beyond that only
    rows that may go are shuffled, by a bitmap of bounded size."""
    own, names = private(docs, "doc_id", "text")
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key")).distinct()
    own = own.withColumn("row_key", row_key())
    same = (F.col("row_key") == F.col("gone_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id"))
    if gone.count() <= SMALL_ROWS:
        return own.join(F.broadcast(gone), same, "left_anti").select(*names).toDF(*names.values())
    own = own.withColumn("k", F.pmod(F.xxhash64("row_key"), F.lit(SIEVE_BITS))).join(F.broadcast(sieve(gone.select("gone_key"))), F.shiftright("k", 6) == F.col("sieve_cell"), "left")
    own = own.withColumn("hit", F.coalesce(F.expr("(shiftright(sieve_bits, cast(k % 64 as int)) & 1) = 1"), F.lit(False)))
    stay = own.filter("hit").join(gone, same, "left_anti")
    return own.filter("not hit").select(*names).union(stay.select(*names)).toDF(*names.values())


def shuffles(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def in_group(column: str, remainder: int = 2, of: int = 4):
    """Whether crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % of == remainder, F.lit(False))


#: Bits of a sieve; as rows of 64 bits it has at most 131,072 (2 MB), whatever it is built from.
SIEVE_BITS = 1 << 23


def sieve(ids: DataFrame) -> DataFrame:
    """A bitmap over the hashes of ids' columns, of bounded size: to be broadcast."""
    k = F.pmod(F.xxhash64(*ids.columns), F.lit(SIEVE_BITS))
    return ids.select(k.alias("k")).groupBy(F.shiftright("k", 6).alias("sieve_cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k % 64 as int))")).alias("sieve_bits"))


def sifted(df: DataFrame, bitmap: DataFrame, *columns: str) -> DataFrame:
    """The rows whose columns may be among those the bitmap was built from; few others, while it isn't full. It
    spares shuffling the rest and decides nothing: an exact join follows. Without a hit, rows go before any shuffle."""
    k = F.pmod(F.xxhash64(*columns), F.lit(SIEVE_BITS))
    return df.withColumn("sieve_k", k).join(F.broadcast(bitmap), F.shiftright("sieve_k", 6) == F.col("sieve_cell")).filter("(shiftright(sieve_bits, cast(sieve_k % 64 as int)) & 1) = 1").drop("sieve_k", "sieve_cell", "sieve_bits")
