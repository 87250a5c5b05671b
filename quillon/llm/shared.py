"""Tables and checkpoints in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder. Where it is unset and Spark runs in
this process alone, as in local tests, a temporary one is made. Intermediate tables are
Parquet, so a lost executor costs only the tasks that it ran, and they are
removed when the driver's interpreter ends or when ``release`` is called.
"""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bitmap (8 MB), its 64-bit words in a row, and parts of a table of which a key may hold more than one until it is dealt to several tasks.
BITS, WORDS, PARTS, LEAST = 1 << 26, 16, 1024, 1000
#: Tables written between two collections of the driver's garbage.
COLLECT = 6
_made: dict[str, SparkSession] = {}
_local: list[str] = []
_count = itertools.count(1)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: the session's, else, on a local master, a temporary one of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="quillon-"))
    return _local[0]


def collect(spark: SparkSession) -> None:
    """Collect the driver's garbage and, with JDK 17.0.9 or later, give back what its native heap (compilers, mostly) holds free."""
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    try:
        at = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        # By the interface's method: the server's own class is not open to callers.
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = at, "systemTrimNativeHeap"
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # another JVM or system
        return


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    Plans and listings of earlier tables are garbage soon, but the driver's heap
    would first grow to its limit; collecting gives that memory back, and lets
    Spark remove the shuffle files and broadcasts that went with them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path, compression=codec)
    _made[path] = spark
    if next(_count) % COLLECT == 0:
        collect(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Remove the tables behind frames that ``stored`` returned and nothing reads any more."""
    for df in frames:
        path = getattr(df, "_quillon_path", None)
        if path and path in _made:
            _remove(path, _made.pop(path))


def _remove(path: str, spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_made.items()):
        try:
            _remove(path, spark)
        except Exception:  # the JVM may be gone already
            return


def text_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of all texts: one column-pruned aggregate that sizes the work."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0])


def _bit(key: str) -> tuple[Column, Column, Column]:
    """(bucket, word in it, value of the bit) of a long in a bitmap."""
    bit = F.pmod(F.xxhash64(key), F.lit(BITS))
    return F.shiftright(bit, 5 + WORDS.bit_length()), F.shiftright(bit, 6).bitwiseAND(WORDS - 1).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))


def named(ids: DataFrame, key: str) -> DataFrame:
    """A bitmap of the longs in ``key``: at most BITS / (64 * WORDS) rows of WORDS longs, whatever the input.

    Longs, not binary: these are added up by hash without a sort, and a row of an
    array is read in place where a binary one would be copied for each look.
    """
    bucket, word, value = _bit(key)
    rows = ids.select(bucket.alias("__bucket"), word.alias("__word"), value.alias("__value"))
    words = [F.bit_or(F.when(F.col("__word") == i, F.col("__value")).otherwise(F.lit(0).cast("long"))).alias(f"__{i}") for i in range(WORDS)]
    return rows.groupBy("__bucket").agg(*words).select("__bucket", F.array(*(f"__{i}" for i in range(WORDS))).alias("__words"))


def marked(df: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """``df`` with column ``__named``: false for rows whose ``key`` is surely none of the bitmap's."""
    bucket, word, value = _bit(key)
    out = df.withColumns({"__bucket": bucket, "__word": word, "__value": value}).join(F.broadcast(bitmap), "__bucket", "left")
    held = F.get("__words", F.col("__word")).bitwiseAND(F.col("__value")) != 0
    return out.withColumn("__named", F.coalesce(held, F.lit(False))).drop("__bucket", "__word", "__value", "__words")


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str | Column, counted: DataFrame | None = None) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row for each ``key``.

    A key with more than a PARTS-th of the rows of ``counted`` (``left`` itself if
    that is cheap to read twice) is dealt to several tasks by a hash of ``spread``,
    and its row of ``right`` is copied to each: there are fewer than PARTS such
    keys and no more than twice as many copies.
    """
    counted = left if counted is None else counted
    least = max(LEAST, counted.count() // PARTS)
    hot = counted.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > least).select(key, F.ceil(F.col("__n") / least).cast("int").alias("__salts"))
    hot = stored(hot, "hot")
    some = F.coalesce("__salts", F.lit(1))
    left = left.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), some).cast("int")).drop("__salts")
    right = right.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), some - 1))).drop("__salts")
    return left.join(right, [key, "__salt"]).drop("__salt")
