"""Language identification in two steps: the family first, then the language within it.

A text is the share of each hashed byte trigram in it. One linear support vector machine a family (against the rest)
picks the family; within it, one machine for each pair of languages votes. Families come from a table; a language that is
not in it joins the family, or the other such languages, that its mean text is most like. The machines are fitted on the
driver on a bounded sample: of each language, however many there are, the distinct texts of least hash, ``per_language``
at most and ``sample_rows`` in all (one a language at least). Every text is then scored in its own task by adding up
weights, with no shuffle.

Defined results: a null text, or one without a letter, is `und` with score 0; with nothing to learn from every text is
`und`, and none with a letter is dropped; repeated rows get equal answers and are learnt from once; ids are not looked
at; ties go to the language that sorts first; very long texts are added up like others; an empty table gives an empty
table; other columns, whatever their names, are not looked at and stay where rows are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep
from .textbytes import let_go, slices

BUCKET_BITS = 12
SHARPNESS = 4.0

# Languages of a family, by ISO 639-1 code.
FAMILIES = {
    "baltic": ["lt", "lv"],
    "bantu": ["sn", "st", "sw", "xh", "zu"],
    "celtic": ["br", "cy", "ga", "gd", "gv", "kw"],
    "dravidian": ["kn", "ml", "ta", "te"],
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "indic": ["as", "bn", "gu", "hi", "mr", "ne", "or", "pa", "sa", "sd", "si", "ur"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "malayic": ["id", "jv", "mg", "mi", "ms", "su", "tl"],
    "romance": ["ca", "co", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro", "sc"],
    "semitic": ["am", "ar", "he", "mt", "ti"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "turkic": ["az", "ba", "kk", "ky", "tk", "tr", "tt", "ug", "uz"],
    "uralic": ["et", "fi", "hu", "se"],
}
#: Cosine of mean texts from which a language outside the table joins others.
LIKE = 0.6


def families(means: dict[str, np.ndarray]) -> dict[str, str]:
    """The family of each language."""
    out = {x: next((f for f, members in FAMILIES.items() if x in members), "") for x in sorted(means)}
    unit = {x: m / max(1e-12, float(np.linalg.norm(m))) for x, m in means.items()}
    for x in out:
        if not out[x]:
            near = max(((float(unit[x] @ unit[y]), out[y]) for y in out if out[y]), default=(0.0, ""))
            out[x] = near[1] if near[0] >= LIKE else f"like {x}"
    return out


def _trigrams(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that begins at each byte, capital ASCII letters folded."""
    d = data.astype(np.uint32)
    d[(d >= 65) & (d <= 90)] += 32
    code = d[:-2] | d[1:-1] << 8 | d[2:] << 16 if len(d) > 2 else d[:0]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go("language")
    for b in batches:
        for at, data, offsets in slices(b.column("text")):
            grams = _trigrams(data)
            rows = [np.bincount(grams[a : max(a, z - 2)], minlength=1 << BUCKET_BITS).astype(np.float32) for a, z in zip(offsets, offsets[1:])]
            rows = [(r / max(1.0, r.sum())).astype("<f4").tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("lang").slice(at, len(rows)), pa.array(rows, pa.binary())], ["lang", "x"])


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 100.0, rounds: int = 120) -> np.ndarray:
    """Weights and bias (last) of a linear machine with squared hinge loss, by accelerated gradient; y is +1 or -1."""
    scale = 1 / max(1e-12, np.sqrt((x * x).sum(1).mean()))
    z = np.hstack([x * scale, np.ones((len(x), 1), x.dtype)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    w = v = np.zeros(z.shape[1], x.dtype)
    step, t = 1 / (1 + c * 2 * float((weight * (z * z).sum(1)).sum())), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (z @ v))
        new = v - step * (v - 2 * c * (z.T @ (weight * y * slack)))
        t, old = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (old - 1) / t * (new - w), new
    return np.append(w[:-1] * scale, w[-1])


@dataclass
class LanguageModel:
    """Machines as columns of weights: families against the rest, then pairs of languages within a family."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, (1 << BUCKET_BITS) + 1)))

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row a text, a column a machine."""
        grams, last = _trigrams(data), np.maximum(offsets[:-1], offsets[1:] - 2)
        out = np.zeros((len(offsets) - 1, len(self.weights)))
        top = len(grams)
        for j, w in enumerate(self.weights):
            sums = np.concatenate([[0.0], np.cumsum(w[:-1][grams])])
            out[:, j] = (sums[np.minimum(last, top)] - sums[np.minimum(offsets[:-1], top)]) / np.maximum(1, last - offsets[:-1]) + w[-1]
        return out

    def choose(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language (an object array) and score of each row of margins."""
        n, k = len(margins), len(self.families)
        chance = 1 / (1 + np.exp(-SHARPNESS * margins))
        lang, score = np.full(n, "und", object), np.zeros(n)
        if not k:
            return lang, score
        best = margins[:, :k].argmax(1) if k > 1 else np.zeros(n, int)
        sure = chance[np.arange(n), best] if k > 1 else np.ones(n)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(best == f)
            votes, low = np.zeros((len(rows), len(self.members[name]))), np.ones((len(rows), len(self.members[name])))
            for j, (a, b) in enumerate(self.pairs):
                if a in self.members[name]:
                    p, ia, ib = chance[rows, k + j], self.members[name].index(a), self.members[name].index(b)
                    votes[:, ia] += (p >= 0.5) + p * 1e-3
                    votes[:, ib] += (p < 0.5) + (1 - p) * 1e-3
                    low[:, ia], low[:, ib] = np.minimum(low[:, ia], p), np.minimum(low[:, ib], 1 - p)
            win = votes.argmax(1)
            lang[rows] = np.array(self.members[name], object)[win]
            score[rows] = sure[rows] * low[np.arange(len(rows)), win]
        return lang, score


def _sample(known: DataFrame, per_language: int, sample_rows: int) -> DataFrame:
    """(lang, text) to learn from, of known(lang, text): distinct texts, those of least hash in each language.

    A hash bound that follows from each language's number of distinct texts leaves about twice the rows wanted before any
    are ranked, so no task sees more of a frequent language than of another."""
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    counts = keep(counts, "languages")  # a row a language
    per = max(1, min(per_language, sample_rows // max(1, counts.count())))
    bound = F.broadcast(counts.select("lang", ((2 * per + 50) / F.col("n")).alias("share")))
    some = known.join(bound, "lang").where(F.pmod(F.col("h"), F.lit(1 << 31)) / (1 << 31) < F.col("share"))
    once = some.groupBy("lang", "h").agg(F.first("text").alias("text"))  # copies of a text meet as one
    rank = Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(1 << 31)), "h")
    return once.withColumn("nth", F.row_number().over(rank)).where(F.col("nth") <= per).select("lang", "text")


def fit_language_model(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", per_language: int = 400, sample_rows: int = 12_800) -> LanguageModel:
    """Learn from the rows of docs for which train holds and the language is known."""
    known = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    got = _sample(known, per_language, sample_rows).mapInArrow(_features, "lang string, x binary").collect()
    if not got:
        return LanguageModel()
    y = np.array([r["lang"] for r in got])
    x = np.stack([np.frombuffer(r["x"], "<f4") for r in got])
    del got
    order = np.lexsort((x @ np.linspace(0, 1, x.shape[1], dtype=x.dtype), y))  # rows come in any order
    x, y = x[order], y[order]
    kin_of = families({lang: x[y == lang].mean(0) for lang in sorted(set(y))})
    members: dict[str, list[str]] = {}
    for lang in sorted(kin_of):
        members.setdefault(kin_of[lang], []).append(lang)
    names = sorted(members)
    kin = np.array([kin_of[lang] for lang in y])
    machines = [fit_svm(x, np.where(kin == f, 1, -1).astype(x.dtype)) for f in names]
    pairs = [p for f in names for p in combinations(members[f], 2)]
    for a, b in pairs:
        two = (y == a) | (y == b)
        machines.append(fit_svm(x[two], np.where(y[two] == a, 1, -1).astype(x.dtype)))
    return LanguageModel(names, members, pairs, np.stack(machines).astype(np.float64))


def _score(model: LanguageModel, text_field: str | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("language")
        for b in batches:
            for at, data, offsets in slices(b.column("text") if text_field is None else b.column("row").field(text_field)):
                lang, score = model.choose(model.margins(data, offsets))
                ascii_letter = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
                for i in np.flatnonzero(ascii_letter[offsets[1:]] == ascii_letter[offsets[:-1]]):
                    if not any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode())):
                        lang[i], score[i] = "und", 0.0
                rest = [b.column(k).slice(at, len(lang)) for k in b.schema.names if k != "text"]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(score)], [*(k for k in b.schema.names if k != "text"), "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, lang_pred, score (0 to 1)."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInArrow(_score(model), f"id {base.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", least_score: float = 0.0) -> DataFrame:
    """docs without the rows that are `und` or score below least_score; all columns stay. A model that has learnt nothing
    rejects only texts without a letter."""
    if not model.families:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    scored = whole.mapInArrow(_score(model, text_col), f"row {whole.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select("row.*")
