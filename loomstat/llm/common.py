"""What the corpus operators share: reading tables, white space, tables kept in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: The white space of the contracts: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bits a row of the bit table of rows to be joined, their bound (32 MB), and the bits of one of its rows (Spark's bitmaps).
ODD_BITS, MOST_BITS, _BUCKET = 32, 1 << 28, 1 << 15

_own: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where that is unset, a folder of our own, in local mode only."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder, and a folder of one machine is of no use to a cluster")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="loomstat-")
    return _own[app]


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def shuffles_go(spark: SparkSession) -> None:
    """Let the shuffles of written tables go: their files stay until the driver no longer knows them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def one_row_each(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of each (id, text) that stays; all columns stay, whatever their names.

    rows(id, mark, stays) has a row for each of docs; mark is the MD5 of the text, null as empty. A row that repeats id and
    text is taken once: these rows are grouped, with the first of each kept, so that no task gathers them.
    """
    each = rows.groupBy("id", "mark").agg(F.bool_or("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    odd = keep(each.where(~F.col("stays") | (F.col("n") > 1)).select("id", "mark", "stays"), "odd-rows")
    shuffles_go(docs.sparkSession)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("own"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("own_mark"))
    here = F.col("own").eqNullSafe(F.col("id")) & (F.col("own_mark") == F.col("mark"))
    # only rows that a bit table of the odd ones lets by are joined: the others, nearly all that stay, are not shuffled
    bits = min(MOST_BITS, max(_BUCKET, 1 << (ODD_BITS * odd.count()).bit_length()))
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(bits))
    of, within = F.expr(f"place DIV {_BUCKET}"), F.expr(f"place % {_BUCKET}")
    table = odd.select(place("id", "mark").alias("place")).groupBy(of.alias("bucket")).agg(F.bitmap_construct_agg(within).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.expr(f"CAST(place % {_BUCKET} DIV 8 AS INT) + 1"), F.lit(1))), 16, 10).cast("int")
    near = whole.withColumn("place", place("own", "own_mark")).withColumn("bucket", of).join(F.broadcast(table), "bucket", "left")  # 32 MB at most
    near = near.select("row", "own", "own_mark", F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, CAST(place % 8 AS INT))")) != 0, F.lit(False)).alias("maybe"))
    met = near.where("maybe").drop("maybe")
    out = near.where(~F.col("maybe")).select("row").unionByName(met.join(odd, here, "left_anti").select("row"))
    repeated = odd.where("stays")
    if not repeated.isEmpty():
        again = met.join(repeated, here).groupBy("own", "own_mark").agg(F.first("row").alias("row")).select("row")
        out = out.unionByName(again)
    return out.select("row.*")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are. Only a text with a capital beyond ASCII needs the slow way."""
    capital = text.rlike(r"[\x{80}-\x{10FFFF}&&[\p{Lu}\p{Lt}\p{Nl}\p{So}\p{Cn}]]")  # all that lower() changes, and some more
    plain = (F.length(text) == F.octet_length(text)) | ~capital
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def without_white(text: Column) -> Column:
    """text without any of the six white-space characters."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text
