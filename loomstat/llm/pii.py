"""Personal data: exact base patterns, then bootstrapped contextual extraction.

The base patterns find email, ip, card and phone in every text. The same pass lists candidate tokens (words that hold a
digit or an @) with two lexical patterns each: the two words before and the two words after (the ends of a text count as
words). Tokens that base spans cover are seeds of that kind. Spark then scores the graph of patterns and instances
(distinct tokens) in turns: a pattern is worth the mean score of the distinct instances it surrounds and is good if that is
high and enough of them are confident; an instance scores as its best good pattern, seeds stay at 1. Confident instances
count as seeds of the next turn, with the kind of their pattern, so patterns that no base seed has met can follow. The good
patterns of the last turn discover what else they surround, as spans of the kind that most of their instances have.

Defined results: a null text is empty; spans count code points, end exclusive; a discovered span never overlaps a base
span; of several good patterns the one of greatest worth names the kind, then the first in the order of kinds; rows that
repeat an id are judged by their own text, with equal answers for equal texts; very long texts and words are read whole, in
linear time; an empty table gives an empty table; other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit before the match would have started it earlier
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_MARKED = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'`.,;:!?()[]{}<>*#$%&|"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches that do not overlap: from each @, the run of local characters before it and the domain after it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        if domain := _DOMAIN.match(text, at):
            start = at
            while start > done and text[start - 1] in _LOCAL:  # runs between two @ are disjoint: linear in all
                start -= 1
            if start < at:
                out.append((start, domain.end()))
                done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """(start, end) of the base patterns, a list a kind."""
    mail = emails(text) if "@" in text else []
    if not _DIGITS.search(text):
        return [mail, [], [], []]
    ip = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))] if "." in text else []
    card = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            card.append(m.span())
    phone = [m.span() for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15] if "+" in text else []
    return [mail, ip, card, phone]


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=12).hexdigest()


def candidates(text: str, spans: list[list[tuple[int, int]]]) -> list[dict]:
    """Tokens with a digit or an @: the patterns left and right of them, the bare token, its span, the kind of a base span
    that meets it."""
    marks = [m.start() for m in _MARKED.finditer(text)]
    if not marks:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in words]
    taken = sorted((a, z, k) for k, s in zip(KINDS, spans) for a, z in s)
    say = lambda i: text[words[i][0] : words[i][1]].strip(_EDGE).lower() if 0 <= i < len(words) else "\n"
    out: list[dict] = []
    done, first = -1, 0
    for at in marks:
        i = bisect_right(starts, at) - 1
        if i <= done:
            continue
        done = i
        a, z = words[i]
        raw = text[a:z]
        bare = raw.strip(_EDGE)
        if not bare:
            continue
        start = a + raw.index(bare)
        end = start + len(bare)
        while first < len(taken) and taken[first][1] <= start:
            first += 1
        kind, last = None, i
        if first < len(taken) and taken[first][0] < end:  # a base span may go over several words: they are one instance
            x, y, kind = taken[first]
            bare, last = text[x:y], max(i, bisect_right(starts, y - 1) - 1)
            done, start, end = last, min(start, x), max(end, y)
        left, right = (_digest(f"{side} {say(p)} {say(p + 1)}") for side, p in (("<", i - 2), (">", last + 1)))
        out.append({"left": left, "right": right, "token": _digest(bare), "start": start, "end": end, "kind": kind})
    return out


_CAND = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string()), ("token", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
_BASE = pa.schema([("id", pa.int64()), ("mark", pa.string()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()), ("found", _CAND)])
_BASE_SQL = "id long, mark string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, found array<struct<left:string,right:string,token:string,start:int,end:int,kind:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: dict[str, list] = {f.name: [] for f in _BASE}
        for i, mark, t in zip(b.column("id"), b.column("mark"), b.column("text")):
            text = t.as_py()
            spans = base_spans(text)
            cols["id"].append(i.as_py())
            cols["mark"].append(mark.as_py())
            for k, s in zip(KINDS, spans):
                cols[f"n_{k}"].append(len(s))
            cols["base"].append(",".join(f"{k}:{a}:{z}" for k, s in zip(KINDS, spans) for a, z in s))
            cols["found"].append(candidates(text, spans))
        yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in _BASE], schema=_BASE)


def good_patterns(occurrences: DataFrame, rounds: int, least_score: float, least_seeds: int) -> DataFrame:
    """(pattern, worth, rank) of the patterns that may discover, from occurrences(pattern, token, rank); rank is the kind's place
    in KINDS, null where it is not known."""
    edges = occurrences.groupBy("pattern", "token").agg(F.min("rank").alias("rank"))
    # a pattern with fewer instances than it needs seeds can never be good
    wide = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_seeds).select("pattern")
    edges = keep(edges.join(wide, "pattern", "left_semi"), "pattern-edges")
    seeds = edges.groupBy("token").agg(F.min("rank").alias("rank")).select("token", "rank", F.col("rank").isNotNull().cast("double").alias("score"))
    score = seeds
    sure = F.col("score") >= least_score
    for turn in range(rounds):
        counts = [F.count_if(sure & (F.col("rank") == k)).alias(f"k{k}") for k in range(len(KINDS))]
        worth = edges.select("pattern", "token").join(score, "token").groupBy("pattern").agg(F.avg("score").alias("worth"), F.count_if(sure).alias("sure"), *counts)
        most = F.greatest(*[F.col(f"k{k}") for k in range(len(KINDS))])
        kind = F.coalesce(*[F.when(F.col(f"k{k}") == most, F.lit(k)) for k in range(len(KINDS))])
        good = keep(worth.where((F.col("worth") >= least_score) & (F.col("sure") >= least_seeds)).select("pattern", "worth", kind.alias("rank")), "good-patterns")
        if turn + 1 < rounds:
            best = edges.select("pattern", "token").join(good, "pattern").groupBy("token").agg(F.max(F.struct("worth", (-F.col("rank")).alias("low"))).alias("best"))
            known = F.col("rank").isNotNull()
            joined = seeds.join(best, "token", "left")
            score = keep(joined.select("token", F.when(known, F.col("rank")).otherwise(-F.col("best.low")).alias("rank"), F.when(known, 1.0).otherwise(F.coalesce("best.worth", F.lit(0.0))).alias("score")), "instance-scores")
    return good


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, least_score: float = 0.75, least_seeds: int = 5) -> DataFrame:
    """Per row of docs: id_col, n_email, n_ip, n_card, n_phone, base (spans of the patterns), discovered (spans found by
    context), spans (both), each kind:start:end by kind and start."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("mark", F.md5("text"))
    scanned = keep(base.mapInArrow(_scan, _BASE_SQL), "base-spans")
    kinds = F.array(*map(F.lit, KINDS))
    found = scanned.select("id", "mark", F.explode("found").alias("c")).select("id", "mark", "c.*").withColumn("rank", (F.array_position(kinds, F.col("kind")) - 1).cast("int"))
    sides = found.select("id", "mark", "token", "start", "end", "rank", F.explode(F.array("left", "right")).alias("pattern"))
    good = good_patterns(sides.select("pattern", "token", "rank"), rounds, least_score, least_seeds)
    new = sides.where(F.col("rank").isNull()).drop("rank").join(good, "pattern").groupBy("id", "mark", "start", "end").agg(F.max(F.struct("worth", (-F.col("rank")).alias("low"))).alias("best"))
    new = new.groupBy(F.col("id").alias("n_id"), F.col("mark").alias("n_mark")).agg(F.array_sort(F.collect_set(F.struct((-F.col("best.low")).alias("rank"), "start", "end"))).alias("new"))
    out = scanned.drop("found").join(new, F.col("id").eqNullSafe(F.col("n_id")) & (F.col("mark") == F.col("n_mark")), "left")
    told = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat(F.get(kinds, s["rank"]), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")
    split = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.split(x, ":"))
    structs = F.transform(split, lambda x: F.struct((F.array_position(kinds, x[0]) - 1).cast("int").alias("rank"), x[1].cast("int").alias("start"), x[2].cast("int").alias("end")))
    both = F.when(F.col("new").isNull(), F.col("base")).otherwise(told(F.array_sort(F.concat(structs, F.col("new")))))
    return out.select(F.col("id").alias(id_col), *[f"n_{k}" for k in KINDS], "base", F.coalesce(told(F.col("new")), F.lit("")).alias("discovered"), both.alias("spans"))
