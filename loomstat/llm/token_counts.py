"""Token counts by overlap resynchronisation.

A text of more than ``chunk_chars`` characters is cut into chunks that overlap; each is encoded by itself, with the byte
offsets of its units. Two neighbours are spliced at the first place in their overlap where both encodings have a
boundary that holds whatever stands around it (see units.py). Where an overlap has no such place, that document's
overlaps are widened and it is cut anew, until at last one chunk holds it all. Chunks of one document are rows, so they
are encoded by many tasks; what meets again is one small row a chunk.

Places are byte offsets and the ids between two of them never depend on what stands outside, so an overlap fails only
where it holds no such place (a long run without spaces); token offsets are compared by way of the counts before each.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows each get their row; very long texts are cut
in one linear pass; an empty table gives an empty table; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .textbytes import slices
from .units import boundaries, encoder

_COUNTED = "id long, n_bytes long, n_tokens long"
_CUT_SQL = "row string, id long, k int, chunks int, left int, right int, text string"
_CHUNK = "row string, id long, k int, chunks int, n_bytes long, n_tokens long, left_at array<int>, left_n array<long>, right_at array<int>, right_n array<long>"


def _count_whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in slices(b.column("text")):
                n = encoder(path).counts(data, offsets)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(at, len(n)), pa.array(np.diff(offsets)), pa.array(n.astype(np.int64))], ["id", "n_bytes", "n_tokens"])

    return run


def _count_chunks(path: str):
    """Of each chunk: its tokens, and for its overlaps the places of stable boundaries with the tokens before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for at, data, offsets in slices(b.column("text")):
                start, _, n, first = encoder(path).lookup(data, offsets)
                before = np.concatenate([[0], np.cumsum(n)])
                for i in range(len(offsets) - 1):
                    a, z = int(offsets[i]), int(offsets[i + 1])
                    own = b.slice(at + i, 1).to_pylist()[0]
                    cuts = start[first[i] : first[i + 1]]
                    cuts, tokens = cuts[cuts > a], before[first[i] : first[i + 1]][cuts > a] - before[first[i]]
                    left, right = cuts - a < own["left"], cuts - a >= z - a - own["right"]
                    out.append({k: own[k] for k in ("row", "id", "k", "chunks")} | {"n_bytes": z - a - own["right"], "n_tokens": int(before[first[i + 1]] - before[first[i]]), "left_at": (cuts[left] - a).tolist(), "left_n": tokens[left].tolist(), "right_at": (cuts[right] - (z - own["right"])).tolist(), "right_n": tokens[right].tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("row", pa.string()), ("id", pa.int64()), ("k", pa.int32()), ("chunks", pa.int32()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), *((f"{s}_{x}", pa.list_(t)) for s in ("left", "right") for x, t in (("at", pa.int32()), ("n", pa.int64())))]))

    return run


_CUT = pa.schema([("row", pa.string()), ("id", pa.int64()), ("k", pa.int32()), ("chunks", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("text", pa.string())])


def _cut(chunk: int, overlap: int):
    """A row a chunk: text from character k * chunk on, with `overlap` characters of the next one; left, right: bytes of its
    overlaps. One pass over each text, which is handed on in pieces of about a MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in slices(b.column("text"), 0):
                opens = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                edge = lambda i: opens[np.minimum(i, len(opens) - 1)]
                first = np.arange(0, max(1, len(opens) - 1), chunk)
                begin, over, end, both = (edge(first + n) for n in (0, overlap, chunk, chunk + overlap))
                own, rows = b.slice(at, 1).to_pylist()[0], []
                for k in range(len(first)):
                    text = data[begin[k] : both[k]].tobytes().decode()
                    rows.append({"row": own["row"], "id": own["id"], "k": k, "chunks": len(first), "left": int(over[k] - begin[k]) if k else 0, "right": int(both[k] - end[k]), "text": text})
                    if len(rows) * chunk >= 1 << 20 or k + 1 == len(first):
                        yield pa.RecordBatch.from_pylist(rows, schema=_CUT)
                        rows = []

    return run


def _splice(chunks: DataFrame) -> DataFrame:
    """(row, id, copies, n_bytes, n_tokens); n_tokens is null where an overlap has no boundary that both encodings have."""
    # a set: the chunks of a repeated row are the same structs
    whole = F.array_sort(F.collect_set(F.struct("k", "n_bytes", "n_tokens", "left_at", "left_n", "right_at", "right_n")))
    docs = chunks.groupBy("row", "id").agg(whole.alias("cs"), F.count_if(F.col("k") == 0).cast("int").alias("copies"))

    def joined(i):
        """Tokens of the left chunk behind the splice plus those of the right one before it: what counting both has too much."""
        a, b = F.get(F.col("cs"), i), F.get(F.col("cs"), i + 1)
        both = F.array_intersect(a["right_at"], b["left_at"])
        at = F.get(both, F.lit(0))
        return a["n_tokens"] - F.get(a["right_n"], (F.array_position(a["right_at"], at) - 1).cast("int")) + F.get(b["left_n"], (F.array_position(b["left_at"], at) - 1).cast("int"))

    many = F.size("cs") > 1
    surplus = F.when(many, F.transform(F.sequence(F.lit(0), F.greatest(F.size("cs") - 2, F.lit(0))), joined)).otherwise(F.array(F.lit(0).cast("long")))
    add = lambda f: F.aggregate(F.col("cs"), F.lit(0).cast("long"), lambda s, c: s + c[f])
    return docs.select("row", "id", "copies", add("n_bytes").alias("n_bytes"), (add("n_tokens") - F.aggregate(surplus, F.lit(0).cast("long"), lambda s, x: s + x)).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32_768, overlap_chars: int = 256) -> DataFrame:
    """Per row of docs: id_col, n_bytes, n_tokens under the vocabulary file at path."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = base.where(F.length("text") <= chunk_chars).mapInArrow(_count_whole(path), _COUNTED)
    left = base.where(F.length("text") > chunk_chars).withColumn("row", F.md5("text"))
    while True:
        chunks = left.select("row", "id", "text").mapInArrow(_cut(chunk_chars, overlap_chars), _CUT_SQL).repartition("row", "id", "k").mapInArrow(_count_chunks(path), _CHUNK)
        done = keep(_splice(chunks), "spliced")
        copies = F.explode(F.array_repeat(F.struct("id", "n_bytes", "n_tokens"), F.col("copies"))).alias("x")
        out = out.unionByName(done.where(F.col("n_tokens").isNotNull()).select(copies).select("x.*"))
        failed = done.where(F.col("n_tokens").isNull()).select("row").distinct()
        if failed.isEmpty():
            return out.withColumnRenamed("id", id_col)
        left = left.join(failed, "row", "left_semi")
        overlap_chars *= 8
        chunk_chars = max(chunk_chars, overlap_chars)
