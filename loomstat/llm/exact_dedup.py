"""Exact dedup, safe against hot groups: texts equal after deleting white space form a group.

Rows are grouped by (digest, content): tasks combine their own copies before the shuffle, so a hot group is a row a task, and
contents are shuffled once. The whole content is a grouping key, so equality never rests on the digest; what is joined back is
salted. DataFrame functions only.

Defined results: a null text counts as ""; of equal texts the one with the most code points in the original stays, then
the smallest id, null ids last, then the text of greatest MD5 (two original texts under one id); rows that repeat id and text get the same
answer; very long texts are values like others; an empty table gives an empty table; other columns of the input,
whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, one_row_each, shuffles_go, without_white


def _grouped(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """Per row of docs: id, mark (MD5 of the text), digest, found (more than one row is equal), keep_id, keep_mark, n."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = base.select("id", F.md5("text").alias("mark"), F.length("text").alias("chars"), without_white(F.col("text")).alias("content"))
    # the row that stays has the greatest rank: most characters, then least id (null last), then greatest mark
    rank = F.struct(F.col("chars"), (-F.coalesce("id", F.lit(2**63 - 1))).alias("low"), F.col("id").isNotNull().alias("known"), "mark")
    salt = F.pmod(F.xxhash64("mark", "id"), F.lit(salts)).cast("int").alias("salt")
    rows = rows.select("id", "mark", "content", F.sha2("content", 256).alias("digest"), rank.alias("rank"), salt)
    best = [F.max("rank").alias("rank"), F.sum("n").alias("n")]
    groups = rows.select("digest", "content", "rank", F.lit(1).cast("long").alias("n")).groupBy("digest", "content").agg(*best)
    by_digest = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.max("rank").alias("rank"), F.sum("n").alias("n")).where(F.col("n") > 1)
    winner = [F.when(F.col("rank.known"), -F.col("rank.low")).alias("keep_id"), F.col("rank.mark").alias("keep_mark"), "n"]
    many = keep(by_digest, "exact-groups")  # groups of one row need no join
    shuffles_go(docs.sparkSession)
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    won = many.where(F.col("contents") == 1).select("digest", every.alias("salt"), *winner, F.lit(True).alias("found"))
    out = rows.select("id", "mark", "digest", "salt").join(won, ["digest", "salt"], "left").drop("salt")
    clash = many.where(F.col("contents") > 1).select("digest")
    if not clash.isEmpty():  # different contents under one digest: these rows are told apart by content
        exact = rows.join(clash, "digest", "left_semi").select("id", "mark", "digest", "content").join(groups.select("digest", "content", *winner), ["digest", "content"])
        exact = exact.select("digest", "id", "mark", "keep_id", "keep_mark", "n", F.lit(True).alias("found"))
        out = out.join(clash, "digest", "left_anti").unionByName(exact)
    return out


def _stays():
    """A row of a group stays if it has the winner's id and text; a row alone always does."""
    return F.when(F.col("found"), F.col("keep_id").eqNullSafe(F.col("id")) & (F.col("keep_mark") == F.col("mark"))).otherwise(F.lit(True))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """Per row of docs: id_col, keep_id, group_size, kept, text_sha256 (of the text without white space)."""
    return _grouped(docs, id_col, text_col, salts).select(
        F.col("id").alias(id_col),
        F.when(F.col("found"), F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        _stays().alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """docs with one row of each group of equal texts; all columns stay. Rows are told apart by id and text: a row that
    repeats an id with another text is judged by its own text, and of rows that repeat both one stays."""
    return one_row_each(docs, _grouped(docs, id_col, text_col, salts).select("id", "mark", _stays().alias("stays")), id_col, text_col)
