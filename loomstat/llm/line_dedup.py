"""Line dedup: lines whose key occurs in many documents are taken out of every document.

Lines are exploded, their keys hashed, distinct documents counted for each hash, and what is left is
put together again by position. DataFrame functions only.

Defined results: a null or empty text is one empty line; keys under ``min_chars`` code points are never dropped;
rows of one id count as one document (rows without an id too), and each gets its own answer; very long texts are split like others; a document all of whose lines go keeps "";
an empty table gives an empty table; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, keep, lower_ascii


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def _hash(line: Column, min_chars: int) -> Column:
    key = line_key(line)
    return F.when(F.length(key) >= min_chars, F.md5(key))


def line_keys(base: DataFrame, min_chars: int) -> DataFrame:
    """(id, mark, keys) of base(id, mark, text): the hash of each line's key, null where it is too short. Written, as it is read twice."""
    keys = F.transform(F.split("text", "\n", -1), lambda x: _hash(x, min_chars))
    return keep(base.select("id", "mark", keys.alias("keys")), "line-keys")


def frequent_lines(keyed: DataFrame, min_docs: int) -> DataFrame:
    """(key, n_docs) of the line keys found in at least min_docs documents of keyed; rows of one id are one document.

    Where no id repeats, rows are counted, which combines in the tasks; only lines of repeated ids are made distinct by id.
    """
    lines = keyed.select("id", F.explode(F.array_distinct("keys")).alias("h")).where(F.col("h").isNotNull())
    repeated = keep(keyed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("again")), "repeated-ids")
    counted = lines.select("h")
    if not repeated.isEmpty():
        same = F.col("id").eqNullSafe(F.col("again"))
        counted = lines.join(repeated, same, "left_anti").select("h").unionByName(lines.join(repeated, same, "left_semi").distinct().select("h"))
    return counted.groupBy(F.unhex("h").alias("key")).agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, salts: int = 8) -> DataFrame:
    """Per row of docs: id_col, n_lines, n_dropped, kept_text.

    The frequent keys are a written table, so the planner knows their size: small, they are broadcast under Spark's own
    threshold; large, lines are joined to them by (key, salt), which splits the rows of a very frequent line.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    keyed = line_keys(base, min_chars)
    frequent = keep(frequent_lines(keyed, min_docs), "frequent-lines")
    salted = frequent.select("key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    lines = keyed.select("id", "mark", F.posexplode("keys").alias("pos", "h")).where(F.col("h").isNotNull())
    lines = lines.select("id", "mark", "pos", F.unhex("h").alias("key"), F.pmod(F.col("mark") + F.col("pos"), F.lit(salts)).cast("int").alias("salt"))
    drops = lines.join(salted, ["key", "salt"]).groupBy("id", "mark").agg(F.collect_set("pos").alias("drops")).select(F.col("id").alias("d_id"), F.col("mark").alias("d_mark"), "drops")
    out = base.join(drops, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("mark") == F.col("d_mark")), "left")
    # one-element transform: the lines are split once a row, not once a position
    left = F.transform(
        F.array(F.split("text", "\n", -1)),
        lambda ls: F.struct(
            F.size(ls).cast("long").alias("n"),
            F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("drops")), lambda i: F.get(ls, i)), "\n").alias("kept"),
        ),
    )[0]
    n_lines = F.length(F.col("text")) - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return out.select(
        F.col("id").alias(id_col),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(left["kept"]).alias("kept_text"),
    )
