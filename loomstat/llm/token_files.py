"""Token-ID files: one concatenated id array a shard, document boundaries in Elias-Fano code.

A shard is one row of a Parquet table: the ids of its documents one after the other (16 bits each where the vocabulary
allows, else 32), the documents' ends and their doc_ids both as Elias-Fano sequences. Low bits are packed, high bits are a
unary bit vector with the number of ones sampled every 256 bytes, and a select over it gives any boundary from one such
stretch, so no table of 64-bit offsets is kept. Parquet in a folder
that Spark writes to keeps the files whole when an executor is lost and readable on any store.

Shards hold documents in ascending id (null ids first, then by the text's hash), because rows are range-partitioned and
sorted before they are encoded; part and seq give the shards' order.

Defined results: a null or empty text is the end id alone; repeated rows are documents of their own, one behind the
other; an empty table gives no shard and no row; other columns of the input are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textbytes import ranges, slices
from .units import encoder

SHARD = "part int, seq int, n_docs long, n_null long, n_ids long, width int, ids binary, first_id long, span long, id_low binary, id_high binary, id_ranks binary, end_low binary, end_high binary, end_ranks binary"
#: Bytes of high bits between two samples of select.
RANKED = 256
_DOC = "part int, seq int, id long, start long, n_tokens long, ids_crc32 long"
_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)
_NTH = np.array([[([b for b in range(8) if i >> (7 - b) & 1] + [0] * 8)[j] for j in range(8)] for i in range(256)], np.int64)


def low_bits(n: int, top: int) -> int:
    return max(0, int(top // n).bit_length() - 1) if n else 0


def ef_encode(values: np.ndarray, top: int) -> tuple[bytes, bytes, bytes]:
    """Low and high parts of a sequence that never falls, of values from 0 to top, and the samples of select: how many ones
    come before each RANKED bytes of the high part (32 bits each)."""
    n, low = len(values), low_bits(len(values), top)
    v = values.astype(np.uint64)
    bits = (v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    high = np.zeros(n + int(top >> low) + 1, np.uint8)
    high[(v >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
    ranks = np.cumsum(np.add.reduceat(high, np.arange(0, len(high), 8 * RANKED), dtype=np.int64))
    return np.packbits(bits.astype(np.uint8)).tobytes(), np.packbits(high).tobytes(), np.append(0, ranks[:-1]).astype("<u4").tobytes()


def ef_select(low: bytes, high: bytes, ranks: bytes, n: int, top: int, which: np.ndarray) -> np.ndarray:
    """The values at places `which`: samples name the stretch of the high part, whose bits alone are counted; low bits are
    taken at the places asked for."""
    width, which = low_bits(n, top), np.asarray(which, np.int64)
    raw, sample = np.frombuffer(high, np.uint8), np.frombuffer(ranks, "<u4").astype(np.int64)
    stretch = np.searchsorted(sample, which, "right") - 1
    order = np.argsort(stretch, kind="stable")
    found, at = np.unique(stretch[order], return_index=True)
    place = np.zeros(len(which), np.int64)
    for k, own in zip(found, np.split(order, at[1:])):
        part, nth = raw[k * RANKED : (k + 1) * RANKED], which[own] - sample[k]
        before = np.concatenate([[0], np.cumsum(_ONES[part])])
        byte = np.searchsorted(before, nth, "right") - 1
        place[own] = (k * RANKED + byte) * 8 + _NTH[part[byte], nth - before[byte]]
    value = (place - which) << width
    packed = np.frombuffer(low, np.uint8)
    for b in range(width):
        bit = which * width + b
        value |= (packed[bit >> 3] >> (7 - (bit & 7)) & 1).astype(np.int64) << b
    return value


def _pack(path: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def shard() -> pa.RecordBatch:
            ids, n, keys, null = (np.concatenate(x) for x in zip(*held))
            ends, known = np.cumsum(n), keys[~null]
            first = int(known[0]) if len(known) else 0
            span = int(known[-1]) - first if len(known) else 0
            row = {"part": part, "seq": seq, "n_docs": len(n), "n_null": int(null.sum()), "n_ids": len(ids), "width": ids.dtype.itemsize, "ids": ids.tobytes(), "first_id": first, "span": span}
            row["id_low"], row["id_high"], row["id_ranks"] = ef_encode(known - first, span)
            row["end_low"], row["end_high"], row["end_ranks"] = ef_encode(ends, len(ids))
            return pa.RecordBatch.from_pylist([row], schema=_SHARD_ARROW)

        for b in batches:
            for at, data, offsets in slices(b.column("text")):
                found, cuts = encoder(path).ids(data, offsets)
                n = np.diff(cuts)
                ids = np.full(len(found) + len(n), end_id, found.dtype)
                ids[ranges(cuts[:-1] + np.arange(len(n)), n)] = found
                keys = b.column("id").slice(at, len(n))
                held.append((ids, n + 1, keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False)))
                size += len(ids)
                if size >= shard_ids:
                    yield shard()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield shard()

    return run


_SHARD_ARROW = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in SHARD.split(", ")])


def write_token_files(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_ids: int = 1 << 20) -> None:
    """Encode every text with the vocabulary file at path and write the shards to folder."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = base.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(_pack(path, end_id, shard_ids), SHARD).write.parquet(folder)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in range(b.num_rows):
            s = {k: v[0] for k, v in b.slice(row, 1).to_pydict().items()}
            n, null = s["n_docs"], s["n_null"]
            ends = ef_select(s["end_low"], s["end_high"], s["end_ranks"], n, s["n_ids"], np.arange(n))
            known = s["first_id"] + ef_select(s["id_low"], s["id_high"], s["id_ranks"], n - null, s["span"], np.arange(n - null))
            starts = np.concatenate([[0], ends[:-1]])
            wide = np.frombuffer(s["ids"], np.dtype(f"<u{s['width']}")).astype("<u4")
            crc = [zlib.crc32(wide[a:z]) for a, z in zip(starts, ends)]
            ids = pa.array(np.concatenate([np.zeros(null, np.int64), known]), mask=np.arange(n) < null)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, s["part"], np.int32)), pa.array(np.full(n, s["seq"], np.int32)), ids, pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())], ["part", "seq", "id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of the shards in folder: id_col, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema(SHARD).parquet(folder)
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row a writing task
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    bases = sizes.select("part", "seq", inside.alias("inside")).join(parts, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("base"))
    rows = files.mapInArrow(_unpack, _DOC).join(bases, ["part", "seq"])
    return rows.select(F.col("id").alias(id_col), (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
