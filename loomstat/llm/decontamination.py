"""Benchmark decontamination by templates. DataFrame functions only.

Numbers, names (runs of capitalised words, one placeholder a run) and units after numbers become typed placeholders; every
window of five template tokens of a document is hash-joined with the windows of the benchmark items. A capitalised word that
opens a sentence counts as a name too, since it cannot be told from one ('Tom has 5 ...'). So that documents in other letter
case are found as well, an item is also read with the words that open sentences, and with all names, as plain words; the
reading that fits best counts. An item leaks into a document
when at least ``least_share`` of its distinct windows are found there and its slots are filled consistently: one value
of an item goes with one value of the document. So a question asked again with other numbers or names is caught, a
chance meeting of placeholders is not; it is asked from either side. Both are asked of each occurrence (windows at equal or near distances from their
place in the item) and of the document as a whole, and one that holds is enough; variants and siblings beside it take
nothing from it. Windows found word for word need no slots.

Defined results: null or empty texts have no window; an item or document of fewer than five tokens has one window of all
of them; rows that share an id, or have none, are judged one by one and never together, on both sides; repeated rows get
equal answers, once an (id, item); very long texts are exploded window by window; an empty table on either side gives an
empty table; other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

NAME, NUMBER, UNIT, JOINT = "\ue000", "\ue001", "\ue002", "\ue003"  # private use, in no text that means anything

# Unit words and signs that may follow a number.
UNITS = ["%", "°c", "°f", "cm", "dollars", "eur", "euros", "feet", "g", "h", "hours", "hz", "in", "inches", "kg", "kj", "km", "kwh", "l", "lb", "liters", "m", "mg", "miles", "min", "minutes", "ml", "mm", "ms", "oz", "s", "seconds", "usd", "w", "watts", "yards", "years"]
#: Windows of benchmark items that are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
#: Words that an occurrence of an item may gain or lose and still be told from another one in the same document.
SHIFT = 8


def named(text: Column) -> Column:
    """NAME before each capitalised word (not in capitals), JOINT between the words of a run in place of the space."""
    t = F.regexp_replace(text, r"(?<![\p{L}\p{N}]|[\p{L}\p{N}]['’-])(\p{Lu}\p{Ll}[\p{L}'-]*)", f"{NAME}$1")
    return F.regexp_replace(t, rf"({NAME}[\p{{L}}'-]+) (?={NAME})", f"$1{JOINT}")


def named_inside(text: Column) -> Column:
    """As named, but the words that open a sentence stay plain."""
    opens = rf"(?<![\p{{Ll}},;] )(?<!{JOINT}){NAME}([\p{{L}}'-]+)"
    return F.regexp_replace(F.regexp_replace(named(text), opens + JOINT, "$1 "), opens, "$1")


def marked(t: Column) -> Column:
    """Lower-cased words, numbers and units behind a marker of their type, as names are in t, without punctuation."""
    t = F.regexp_replace(t, r"(^|[^\p{L}\p{N}])(\p{N}[\p{N}.,]*)", f"$1{NUMBER}$2")
    t = F.regexp_replace(t, rf"(?i)({NUMBER}[\p{{N}}.,]+ ?)({'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")
    t = F.regexp_replace(t, r"[\p{P}\p{S}&&[^%°]]+|\p{M}+", "")
    return F.trim(F.regexp_replace(F.lower(t), r"[\s\p{Z}]+", " "))


def template(marked_text: Column) -> Column:
    """The placeholders in place of the marked words."""
    return F.regexp_replace(marked_text, rf"([{NAME}{NUMBER}{UNIT}])\S+", "$1")


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart by id and text: rows that share an id, or have none, are documents of their own."""
    return F.concat_ws(":", F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def windows(docs: DataFrame, id_col: str, text_col: str, width: int, readings: bool = False) -> DataFrame:
    """(id, row, pos, h, piece): a row a window; row is the key of the document, piece are the window's marked words, pos its
    first word, from 0. With readings, all of them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row")]
    base = docs.select(*own, F.lit(0).alias("reading"), marked(named(text)).alias("m"))
    if readings:
        base = docs.select(*own, F.posexplode(F.array_distinct(F.array(marked(named(text)), marked(named_inside(text)), marked(text)))).alias("reading", "m"))
    split = base.select("id", "row", "reading", F.split("m", " ").alias("words"), F.split(template(F.col("m")), " ").alias("w"))
    # places are exploded and each window hashed behind that, in compiled code; an empty text is one empty word
    places = F.when((F.size("w") > 1) | (F.get("w", F.lit(0)) != ""), F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0))))
    each = split.select("id", "row", "reading", "words", "w", F.explode(places).alias("pos"))
    h = F.when(F.size("w") < width, F.xxhash64("w")).otherwise(F.xxhash64(*[F.get("w", F.col("pos") + k) for k in range(width)]))
    return each.select("id", "row", "reading", "pos", h.alias("h"), F.slice("words", F.col("pos") + 1, F.lit(width)).alias("piece"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 5, least_share: float = 0.75, salts: int = 16) -> DataFrame:
    """(id_col, item_col, share, consistency) of the items found in documents, by the best occurrence of each."""
    return _best(_leaks(docs, benchmark, id_col, text_col, item_col, item_text, width, least_share, salts), "id", "item").withColumnsRenamed({"id": id_col, "item": item_col})


def _best(found: DataFrame, *by: str) -> DataFrame:
    best = found.groupBy(*by).agg(F.max(F.struct(F.least("share", "consistency").alias("least"), "share", "consistency")).alias("o"))
    return best.select(*by, "o.share", "o.consistency")


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, width: int, least_share: float, salts: int) -> DataFrame:
    """(id, row, item, share, consistency): an item of the benchmark (a row of it) found in a row of docs."""
    items = windows(benchmark, item_col, item_text, width, True).select(F.col("id").alias("item"), F.col("row").alias("item_row"), "reading", F.col("pos").alias("item_pos"), "h", F.col("piece").alias("item_words"))
    items = keep(items, "item-windows")
    n_items = items.count()
    found = windows(docs, id_col, text_col, width).drop("reading")
    if n_items <= BROADCAST_WINDOWS:
        hits = found.join(F.broadcast(items), "h")
    else:  # a benchmark that outgrows a broadcast: by (window, salt), so that a frequent window is split
        salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hits = found.withColumn("salt", F.pmod(F.xxhash64("row", "pos"), F.lit(salts)).cast("int")).join(salted, ["h", "salt"])
    hits = hits.select("id", "row", "item", "item_row", "reading", "item_pos", (F.col("pos") - F.col("item_pos")).alias("at"), "h", F.col("piece").alias("doc_words"), "item_words")
    hits = keep(hits, "window-hits")  # read again below
    own = F.when(F.exists("item_words", lambda w: ~w.rlike(f"^[{NAME}{NUMBER}{UNIT}]")), F.col("h"))  # of windows with a literal word
    distinct = lambda c: F.size(F.collect_set(c))  # noqa: E731  (at most the windows of an item)
    sizes = items.groupBy("item_row", "reading").agg(distinct("h").alias("n"), distinct(own).alias("n_own"), distinct("item_words").alias("n_words"))
    same = F.when(F.col("doc_words") == F.col("item_words"), F.col("item_words"))
    pairs = hits.groupBy("id", "row", "item", "item_row", "reading").agg(distinct("h").alias("got"), distinct(same).alias("got_words")).join(F.broadcast(sizes) if n_items <= BROADCAST_WINDOWS else sizes, ["item_row", "reading"])
    pairs = pairs.where((F.col("got") >= least_share * F.col("n")) | (F.col("got_words") >= least_share * F.col("n_words")))
    pairs = keep(pairs, "document-items")
    word_for_word = pairs.where(F.col("got_words") >= least_share * F.col("n_words")).select("id", "row", "item", (F.col("got_words") / F.col("n_words")).alias("share"), F.lit(1.0).alias("consistency"))

    # an occurrence (kind, place): windows at one distance, at distances within SHIFT (twice, so that no bound parts them), anywhere
    near = hits.join(pairs.where(F.col("got") >= least_share * F.col("n")).select("row", "item_row", "reading", "n", "n_own"), ["row", "item_row", "reading"])
    near = near.withColumn("support", F.count(F.lit(1)).over(Window.partitionBy("row", "item_row", "reading", "at")))
    ways = [F.col("at"), F.floor(F.col("at") / (2 * SHIFT)), F.floor((F.col("at") + SHIFT) / (2 * SHIFT)), F.lit(0)]
    near = near.withColumn("o", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), w.cast("long").alias("place")) for k, w in enumerate(ways)])))
    key = ["row", "item_row", "reading", "kind", "place"]
    near = near.select("*", "o.kind", "o.place").drop("o")
    shares = near.groupBy(*key, "id", "item", "n", "n_own").agg(distinct("h").alias("got"), distinct(own).alias("got_own"))
    literal = (F.col("n_own") > 0) & (F.col("got_own") >= least_share * F.col("n_own"))  # placeholders alone meet by chance
    shares = shares.where((F.col("got") >= least_share * F.col("n")) & ((F.col("kind") == len(ways) - 1) | literal)).select(*key, "id", "item", (F.col("got") / F.col("n")).alias("share"))
    # a window of the item that meets several within SHIFT counts at the distance with the most windows
    chosen = near.join(shares.select(*key), key, "left_semi")
    chosen = chosen.withColumn("best_at", F.max(F.struct("support", "at")).over(Window.partitionBy(*key, "item_pos")))
    chosen = chosen.where((F.col("kind") == len(ways) - 1) | (F.col("at") == F.col("best_at.at")))
    slots = chosen.select(*key, F.explode(F.arrays_zip("item_words", "doc_words")).alias("s")).select(*key, F.col("s.item_words").alias("a"), F.col("s.doc_words").alias("b"))
    slots = slots.where(F.col("a").rlike(f"^[{NAME}{NUMBER}{UNIT}]") & F.col("b").isNotNull())
    counts = slots.groupBy(*key, "a", "b").agg(F.count(F.lit(1)).alias("c"))

    def kept(by: str) -> DataFrame:
        """The share of slots in which a value of one side meets its usual value of the other."""
        per = counts.groupBy(*key, by).agg(F.max("c").alias("best"), F.sum("c").alias("all"))
        return per.groupBy(*key).agg((F.sum("best") / F.sum("all")).alias(f"kept_{by}"))

    out = shares.join(kept("a"), key, "left").join(kept("b"), key, "left")
    out = out.select("id", "row", "item", "share", F.coalesce(F.least("kept_a", "kept_b"), F.lit(1.0)).alias("consistency"))
    return out.where(F.col("consistency") >= least_share).unionByName(word_for_word)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold an item; all columns stay. Rows are judged one by one, also where ids repeat or are null."""
    found = _leaks(docs, benchmark, id_col, text_col, "item_id", "text", 5, 0.75, 16)
    bad = keep(found.select(F.col("row").alias("bad")).distinct(), "leaking")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(id_col, text_col).alias("key"))
    return whole.join(bad, F.col("key") == F.col("bad"), "left_anti").select("row.*")
