"""Small helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of bytes other than these; `bytes.split()` splits at the same six.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id gives null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def held_out(doc_id: Column, modulus: int, remainder: int = 2) -> Column:
    """True for the documents no model may learn from.  A null id is not held out."""
    return F.coalesce(fold(doc_id, modulus) == remainder, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir; where it is unset, a folder of our own, on one machine only."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            path = current.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            path = tempfile.mkdtemp(prefix="graphloom-")
        else:
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(path)
    return path.rstrip("/")


#: Shuffle files of a query go when it has ended, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes `df` as Parquet in the shared folder and reads it back: lineage is cut there, and what was shuffled for it leaves the disk."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table of :func:`materialize` that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


BITMAP_BITS = 20


def likely_in(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose long column `key`, a hash, may be in `wanted`: all that are, and some others.

    Goes by a bitmap of fixed size, so it only saves shuffling; an exact join has to follow.
    """
    slot = F.col(key).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    cell = F.shiftrightunsigned(slot, 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    bitmap = wanted.select(cell.alias("_cell"), bit.alias("_bit")).groupBy("_cell").agg(F.expr("bit_or(_bit)").alias("_bits"))
    # 2 ** (BITMAP_BITS - 6) rows of 16 bytes at most
    return rows.withColumn("_cell", cell).join(F.broadcast(bitmap), "_cell").filter(F.col("_bits").bitwiseAND(bit) != 0).drop("_cell", "_bits")


def sample_rows(rows: DataFrame, stratum: str, order: str, bound: int) -> DataFrame:
    """At most `bound` rows of each value of `stratum`: those with the smallest `order`, a 64-bit hash that tells rows apart.

    Repeated rows (of equal order) count once.  Rows whose hash is beyond four
    times the share wanted of their stratum are left out first, so that no
    stratum meets in one task, however large it is.
    """
    # one row a stratum: they are classes, for each of which a model holds more than that on the driver
    counts = F.broadcast(rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_in_stratum")))
    place = F.pmod(F.col(order), F.lit(1 << 62)) / F.lit(float(1 << 62))
    near = rows.join(counts, stratum).filter(place * F.col("_in_stratum") < 4.0 * bound).drop("_in_stratum").dropDuplicates([stratum, order])
    return near.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy(order))).filter(F.col("_rank") <= bound).drop("_rank")


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of `data`, whole and in order, in lists made from about `size` bytes each."""
    if len(data) <= size:
        if words := data.split():
            yield words
        return
    at, end = 0, len(data)
    while at < end:
        stop = min(at + size, end)
        while stop < end and data[stop] not in SPACES:
            stop += 1
        if words := data[at:stop].split():
            yield words
        at = stop


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
