"""SentencePiece encoding and decoding over a relational lattice, for BPE models with byte fallback.

Texts become units: a run of word-start marks with the characters up to the next mark, or a line break (no piece goes
across such a place). The units of all texts are counted, and the frequent ones, as many as ``dictionary_units`` at most,
form a relation: their substrings of bounded length are exploded and equi-joined to the piece table, the matches are the
edges of each unit's lattice, edges are grouped by unit, and Spark's higher-order ``aggregate`` folds them. The resulting
dictionary of units is small by that bound; it is broadcast, and texts are looked up in it and written as ids. Units that
it does not hold are rare ones; their lattice is built and folded in the task that meets them, by the same rule in numpy.

The fold. What a BPE model means by best is no sum of scores, but that its merges, best score first and leftmost among
equals, would give these pieces. So edges are folded in order of (score, place), not from left to right: the state is the
set of places where pieces meet, at first all of them, and an edge whose ends are such places takes the one between them
out if there is just one. Where every piece comes from pieces of better scores, which ``load_pieces`` asserts, no edge
can become possible behind its turn, so one pass gives what merging step by step gives. The edges that end in two
neighbouring places are the pieces. (Runs of marks all share one score; see PieceTable.late for their turn.)

Places are bits of a 64-bit word: a unit of more characters is cut further where no piece holds the two characters side
by side (texts without spaces); what is longer even then (a letter repeated, say) is merged by the library in its task.

Defined results: a null or empty text has no pieces and decodes to ""; a literal U+2581 decodes as a space, as in the
library; repeated rows each get their row; very long texts are cut into units like others; an empty table gives an empty
table; columns that are added take the place of those of their names, all others stay as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep
from .textbytes import CACHES, U64, ranges, slices, span_hashes

MARK = "▁"
#: Characters of a unit whose places fit a state.
LONGEST = 61
#: Units that a worker remembers beside the dictionary; beyond it the memory is emptied and filled anew.
CACHE_UNITS = 300_000
MADE = ["n_pieces", "ids_crc32", "round_trip", "piece_ids"]
_MADE_SQL = "n_pieces long, ids_crc32 long, round_trip boolean, piece_ids array<int>"


@dataclass
class PieceTable:
    """Pieces with marks as spaces, by id; normal: neither byte nor control piece."""

    path: str
    pieces: list[str]
    score: np.ndarray
    normal: np.ndarray
    byte_ids: np.ndarray

    @property
    def late(self) -> np.ndarray:
        """Runs of marks share one score, so that they grow at the left end; a run that does not come of the next shorter one
        waits until its tail is there. By id: the characters before that tail, 0 for all other pieces."""
        runs = {len(p): i for i, (p, ok) in enumerate(zip(self.pieces, self.normal)) if ok and len(p) > 1 and not p.strip(" ")}
        out = np.zeros(len(self.pieces), np.int64)
        for n, i in runs.items():
            if n > 2 and n - 1 not in runs:
                out[i] = max(k for k in runs if k < n)
        return out

    @property
    def longest(self) -> int:
        return max(len(p) for p, ok in zip(self.pieces, self.normal) if ok)

    def relation(self, spark: SparkSession) -> DataFrame:
        """(piece, piece_id, cost, late): a row a normal piece, so as many as the vocabulary has."""
        late = self.late.tolist()
        rows = [(p, i, -float(self.score[i]), late[i]) for i, p in enumerate(self.pieces) if self.normal[i]]
        return spark.createDataFrame(rows, "piece string, piece_id int, cost double, late int")


def merged(text: str, ids: dict[str, int], score: np.ndarray) -> list[str]:
    """Merge neighbours, best score first and leftmost among equals, until none is a piece; the last two parts."""
    symbols, last = list(text), []
    while len(symbols) > 1:
        best = min(((-score[ids[a + b]], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in ids), default=None)
        if best is None:
            return []
        i = best[1]
        last = symbols[i : i + 2]
        symbols[i : i + 2] = ["".join(last)]
    return last


def load_pieces(path: str) -> PieceTable:
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    n = lib.get_piece_size()
    pieces = [lib.id_to_piece(i).replace(MARK, " ") for i in range(n)]
    normal = np.array([not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)) for i in range(n)])
    byte_ids = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    score = np.array([lib.get_score(i) for i in range(n)])
    ids = {p: i for i, p in enumerate(pieces) if normal[i]}
    for p, i in ids.items():
        if "\n" in p or " " in p.lstrip(" "):
            raise ValueError(f"piece {p!r} goes across a place where texts are cut")
        parts = merged(p, ids, score) if len(p) > 1 else []
        if any(len(x) > 1 and score[ids[x]] <= score[i] for x in parts) and p.strip(" "):
            raise ValueError(f"piece {p!r} scores better than one that it is made of")
    if (np.diff(byte_ids) != 1).any():
        raise ValueError("byte pieces are not in a row")
    return PieceTable(path, pieces, score, normal, byte_ids)


def lattice(units: DataFrame, table: PieceTable) -> DataFrame:
    """(unit, edges) of units(unit), which are distinct: substrings joined to the pieces, grouped by unit, in order of fold."""
    pieces = F.broadcast(table.relation(units.sparkSession))  # a row a piece: bounded by the vocabulary
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = units.repartition(parts, "unit").select("unit", F.length("unit").alias("size"), F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("s"))
    each = at.select("unit", "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("s") + table.longest, F.col("size")))).alias("e"))
    each = each.withColumn("part", F.substring(F.col("unit"), F.col("s") + 1, F.col("e") - F.col("s")))
    edges = each.join(pieces, each["part"] == F.col("piece"), "left").where(F.col("piece_id").isNotNull() | (F.col("e") == F.col("s") + 1))
    ends, inner = F.expr("shiftleft(1L, s) | shiftleft(1L, e)"), F.expr("(shiftleft(1L, e) - 1L) & ~(shiftleft(1L, s + 1) - 1L)")
    turn = F.col("s") + F.coalesce("late", F.lit(0))
    edge = F.struct(F.coalesce("cost", F.lit(-1.0)).alias("cost"), turn.alias("turn"), "e", (-F.col("s")).alias("back"), "piece_id", "part", ends.alias("ends"), inner.alias("inner"))
    return edges.groupBy("unit").agg(F.array_sort(F.collect_list(edge)).alias("edges"))  # still dealt by unit: no further shuffle


def folded(edges: DataFrame, table: PieceTable) -> DataFrame:
    """(unit, ids) of lattice rows."""
    first = F.expr("shiftleft(1L, length(unit) + 1) - 1L")
    both = lambda st, e: st.bitwiseAND(e["ends"]) == e["ends"]
    step = lambda st, e: F.when(both(st, e) & (F.bit_count(st.bitwiseAND(e["inner"])) == 1), st.bitwiseAND(F.bitwise_not(e["inner"]))).otherwise(st)
    state = edges.select("unit", "edges", F.aggregate("edges", first, step).alias("state"))
    st = F.col("state")
    kept = F.filter("edges", lambda e: both(st, e) & (st.bitwiseAND(e["inner"]) == 0))
    own = F.array_sort(F.transform(kept, lambda e: F.struct((-e["back"]).alias("s"), e["piece_id"].alias("id"), e["part"].alias("part"))))
    raw = lambda p: F.transform(F.sequence(F.lit(1), F.octet_length(p)), lambda i: (F.conv(F.hex(F.substring(F.encode(p, "UTF-8"), i, F.lit(1))), 16, 10).cast("int") + int(table.byte_ids[0])))
    ids = F.flatten(F.transform(own, lambda x: F.when(x["id"].isNotNull(), F.array(x["id"])).otherwise(raw(x["part"]))))
    return state.select("unit", ids.alias("ids"))


class Units:
    """Texts as units of bytes, marks as spaces."""

    def __init__(self, table: PieceTable) -> None:
        self.side_by_side = {p[k : k + 2] for p, ok in zip(table.pieces, table.normal) if ok for k in range(len(p) - 1)}

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes with a mark before each text that is not empty, where units begin (and the last ends), and each text's
        first unit."""
        full = np.flatnonzero(np.diff(offsets) > 0)
        data = np.insert(data, offsets[full], np.uint8(32))
        offsets = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        mark, line = data == 32, data == 10
        opens = np.zeros(len(data) + 1, bool)
        opens[1:-1] = mark[1:] & ~mark[:-1]
        opens[:-1] |= line
        opens[1:] |= line
        opens[offsets] = True
        bounds = np.flatnonzero(opens)
        letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        more = []
        for i in np.flatnonzero(letters[bounds[1:]] - letters[bounds[:-1]] > LONGEST):
            unit = data[bounds[i] : bounds[i + 1]].tobytes().decode()
            sizes = np.cumsum([len(c.encode()) for c in unit])
            cut = [k for k in range(len(unit) - 1) if unit[k : k + 2] not in self.side_by_side]
            more.append(bounds[i] + sizes[cut])
        if more:
            bounds = np.unique(np.concatenate([bounds, *more]))
        return data, bounds, np.searchsorted(bounds, offsets)


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with literal marks as spaces."""
    if not (data == 0xE2).any() or MARK.encode() not in (raw := data.tobytes()):
        return data, offsets
    parts = [raw[a:z].replace(MARK.encode(), b" ") for a, z in zip(offsets, offsets[1:])]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


class Dictionary:
    """Ids of units by two hashes of their bytes, one after the other in a pool."""

    def __init__(self, keys: np.ndarray, proof: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        order = np.argsort(keys)
        at = np.cumsum(sizes) - sizes
        self.keys, self.proof, self.at, self.n = keys[order], proof[order], at[order], sizes[order]
        self.ids = ids

    @classmethod
    def none(cls) -> Dictionary:
        return cls(np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int64))

    def place(self, keys: np.ndarray, proof: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is not there or the proof is another."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (self.proof[at] == proof), at, -1)

    def added(self, keys: np.ndarray, proof: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Dictionary:
        old = np.argsort(self.at)  # in order of the pool
        return Dictionary(np.concatenate([self.keys[old], keys]), np.concatenate([self.proof[old], proof]), np.concatenate([self.ids, ids]), np.concatenate([self.n[old], sizes]))


class LatticeEncoder:
    """Looks units up in the dictionary, folds those it does not hold, and decodes."""

    def __init__(self, table: PieceTable, frequent: Dictionary) -> None:
        import sentencepiece

        self.table, self.frequent, self.rare, self.units, self.late = table, frequent, Dictionary.none(), Units(table), table.late
        self.lib = sentencepiece.SentencePieceProcessor(model_file=table.path)
        own = [p.encode() if ok else b"" for p, ok in zip(table.pieces, table.normal)]
        for b, i in enumerate(table.byte_ids):
            own[i] = bytes([b])
        sizes = np.array([len(b) for b in own])
        self.text, self.text_at, self.text_n = np.frombuffer(b"".join(own), np.uint8), np.cumsum(sizes) - sizes, sizes
        some = np.flatnonzero(table.normal)
        keys, proof = (span_hashes(self.text, self.text_at[some], self.text_at[some] + sizes[some], k) for k in (0, 1))
        self.pieces = Dictionary(keys, proof, some.astype(np.int32), np.ones(len(some), np.int64))

    def fold(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units data[start:end], one after the other, and the number of each: the lattice of the module's text,
        the k-th edge of all units at a time."""
        flat = data[ranges(start, end - start)]
        base = np.cumsum(end - start) - (end - start)
        opens = np.append(np.flatnonzero((flat & 0xC0) != 0x80), len(flat))
        first = np.searchsorted(opens, base)
        letters = np.diff(np.append(first, len(opens) - 1))
        fit = letters <= LONGEST
        own = np.repeat(np.arange(len(start)), letters)
        s = np.arange(len(own)) - first[own]
        edges = []
        for n in range(1, self.table.longest + 1):  # substrings of n characters, joined to the piece table
            at = np.flatnonzero((s + n <= letters[own]) & fit[own])
            keys, proof = (span_hashes(flat, opens[at], opens[at + n], k) for k in (0, 1))
            hit = self.pieces.place(keys, proof)
            use = hit >= 0 if n > 1 else np.ones(len(at), bool)
            piece = np.where(hit >= 0, self.pieces.ids[self.pieces.at[hit]], -1)
            edges.append((own[at][use], s[at][use], np.full(use.sum(), n), piece[use]))
        unit, s, n, piece = (np.concatenate(x) for x in zip(*edges))
        cost = np.where(piece >= 0, -self.table.score[piece], -1.0)
        order = np.lexsort((-s, s + n, s + np.where(piece >= 0, self.late[piece], 0), cost, unit))
        unit, s, n, piece = unit[order], s[order], n[order], piece[order]
        one = np.uint64(1)
        ends = (one << s.astype(U64)) | (one << (s + n).astype(U64))
        inner = ((one << (s + n).astype(U64)) - one) & ~((one << (s + 1).astype(U64)) - one)
        state = (one << np.minimum(letters + 1, 63).astype(U64)) - one
        size = np.bincount(unit, minlength=len(start))
        begin = np.cumsum(size) - size
        live = np.argsort(-size, kind="stable")
        for k in range(size.max(initial=0)):
            live = live[: np.searchsorted(-size[live], -k, "left")]  # units that have a k-th edge
            e = begin[live] + k
            st = state[live]
            take = ((st & ends[e]) == ends[e]) & (np.bitwise_count(st & inner[e]) == 1)
            state[live] = np.where(take, st & ~inner[e], st)
        kept = np.flatnonzero(((state[unit] & ends) == ends) & ((state[unit] & inner) == 0))
        kept = kept[np.lexsort((s[kept], unit[kept]))]
        got, where = piece[kept].astype(np.int64), first[unit[kept]] + s[kept]
        count = np.where(got >= 0, 1, opens[where + 1] - opens[where])
        out = np.repeat(got, count)
        raw = ranges(opens[where], count)
        out = np.where(out >= 0, out, self.table.byte_ids[flat[raw]])
        sizes = np.bincount(unit[kept], count, minlength=len(start)).astype(np.int64)
        if not fit.all():
            parts = np.split(out, np.cumsum(sizes)[:-1])
            for i in np.flatnonzero(~fit):
                text = data[start[i] : end[i]].tobytes().decode()
                # the library puts a mark before the text: leave out the one that is there, or the extra one
                parts[i] = np.array(self.lib.encode(text[1:]) if text[0] == " " else self.lib.encode("\n" + text)[2:], np.int64)
                sizes[i] = len(parts[i])
            out = np.concatenate(parts)
        return out.astype(np.int32), sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All piece ids, and where each text's begin and end."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if len(self.rare.keys) > CACHE_UNITS:
            self.rare = Dictionary.none()
        data, bounds, first = self.units.of(data, offsets)
        start, end = bounds[:-1], bounds[1:]
        keys, proof = (span_hashes(data, start, end, k) for k in (0, 1))
        order = np.argsort(keys)
        if ((keys[order][1:] == keys[order][:-1]) & (proof[order][1:] != proof[order][:-1])).any():
            order = np.lexsort((proof, keys))  # units that share one hash
        fresh = np.ones(len(order), bool)
        fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (proof[order][1:] != proof[order][:-1])
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(fresh) - 1
        one = order[fresh]
        keys, proof = keys[one], proof[one]
        place = self.frequent.place(keys, proof)
        left = np.flatnonzero(place < 0)
        new = left[self.rare.place(keys[left], proof[left]) < 0]
        if len(new):
            made = [self.fold(data, start[part], end[part]) for part in np.array_split(one[new], 1 + len(new) // 10_000)]
            self.rare = self.rare.added(keys[new], proof[new], *(np.concatenate(x) for x in zip(*made)))
        near = self.rare.place(keys[left], proof[left])
        pool = np.concatenate([self.frequent.ids, self.rare.ids]) if len(left) else self.frequent.ids
        at, n = self.frequent.at[np.maximum(place, 0)] if len(self.frequent.keys) else np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        if len(self.frequent.keys):
            n = self.frequent.n[np.maximum(place, 0)].copy()
        at[left], n[left] = self.rare.at[near] + len(self.frequent.ids), self.rare.n[near]
        n = n[back]
        return pool[ranges(at[back], n)], np.concatenate([[0], np.cumsum(n)])[first]

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes and where each begins and ends: pieces one after the other, without the leading space."""
        n = self.text_n[ids].copy()
        first = cuts[:-1][np.diff(cuts) > 0]
        at = self.text_at[ids].copy()
        n[first] -= 1
        at[first] += 1
        return self.text[ranges(at, n)], np.concatenate([[0], np.cumsum(n)])[cuts]


def _count_units(table: PieceTable):
    """(unit, n): the distinct units of each slice of texts that a state can hold, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(table)
        for b in batches:
            for _, data, offsets in slices(b.column("text"), 1 << 21):
                data, bounds, _ = units.of(*spaced(data, offsets))
                start, end = bounds[:-1], bounds[1:]
                keys, one, n = np.unique(span_hashes(data, start, end), return_index=True, return_counts=True)
                # what a slice of 2 MB has once is not frequent; a clash of hashes only mistakes a count
                one, n = one[n > 1], n[n > 1]
                size = end[one] - start[one]
                own = pa.LargeStringArray.from_buffers(len(one), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(data[ranges(start[one], size)]))
                yield pa.RecordBatch.from_arrays([own.cast(pa.string()), pa.array(n)], ["unit", "n"])

    return run


def frequent_units(docs: DataFrame, table: PieceTable, text_col: str, dictionary_units: int) -> DataFrame:
    """(unit) of the most frequent units of the texts, dictionary_units at most; all of one number or none."""
    base = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = base.mapInArrow(_count_units(table), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    counts = keep(counts.where(F.length("unit") <= LONGEST), "units")
    # powers of 2**(1/8) of the number: a few hundred classes
    level = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    sizes = counts.groupBy(level.alias("level")).count().collect()
    total, least = 0, 1 << 30
    for r in sorted(sizes, key=lambda r: -r["level"]):
        total += r["count"]
        if total > dictionary_units:
            break
        least = r["level"]
    return counts.where(level >= least).select("unit")


def dictionary(units: DataFrame, table: PieceTable) -> Dictionary:
    """The ids of units(unit), which are as many as may be broadcast, by Spark joins and folds."""
    got = keep(folded(lattice(units, table), table), "dictionary").toArrow()
    if not got.num_rows:
        return Dictionary.none()
    text = got["unit"].combine_chunks().cast(pa.large_string())
    (_, _, data), cuts = text.buffers(), np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8)
    ids = got["ids"].combine_chunks()
    keys, proof = (span_hashes(raw, cuts[:-1], cuts[1:], k) for k in (0, 1))
    return Dictionary(keys, proof, ids.flatten().to_numpy().astype(np.int32), np.diff(ids.offsets.to_numpy()).astype(np.int64))


_encoders: dict[str, tuple[int, LatticeEncoder]] = CACHES.setdefault("sentencepiece", {})


def encoder(table: PieceTable, frequent: Broadcast) -> LatticeEncoder:
    """One encoder a worker process, vocabulary and dictionary."""
    if table.path not in _encoders or _encoders[table.path][0] != id(frequent.value):
        _encoders[table.path] = id(frequent.value), LatticeEncoder(table, frequent.value)
    return _encoders[table.path][1]


def _encode(table: PieceTable, frequent: Broadcast, text_field: str | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest = [c for c in b.schema.names if c != "text"]
            text = b.column("text") if text_field is None else b.column("row").field(text_field)
            for at, data, offsets in slices(text):
                own = encoder(table, frequent)
                data, offsets = spaced(data, offsets)
                ids, cuts = own.encode(data, offsets)
                back, ends = own.decode(ids, cuts)
                same = [bool(np.array_equal(back[a:z], data[c:d])) for a, z, c, d in zip(ends, ends[1:], offsets, offsets[1:])]
                crc = [zlib.crc32(ids[a:z].astype("<u4")) for a, z in zip(cuts, cuts[1:])]
                pieces = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
                made = dict(zip(MADE, (pa.array(np.diff(cuts)), pa.array(crc, pa.int64()), pa.array(same), pieces)))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, len(same)) for c in rest), *made.values()], [*rest, *made])

    return run


def _shared(docs: DataFrame, table: PieceTable, text_col: str, dictionary_units: int) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(dictionary(frequent_units(docs, table, text_col, dictionary_units), table))


def encode_pieces(docs: DataFrame, table: PieceTable, id_col: str = "doc_id", text_col: str = "text", dictionary_units: int = 300_000) -> DataFrame:
    """Per row of docs: id_col, n_pieces, ids_crc32 (ids as little-endian 32-bit words), round_trip (decoded as it was), piece_ids."""
    frequent = _shared(docs, table, text_col, dictionary_units)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInArrow(_encode(table, frequent), f"id {base.schema['id'].dataType.simpleString()}, {_MADE_SQL}").withColumnRenamed("id", id_col)


def with_pieces(docs: DataFrame, table: PieceTable, text_col: str = "text", dictionary_units: int = 300_000) -> DataFrame:
    """docs with n_pieces, ids_crc32, round_trip and piece_ids; columns of docs with these names are replaced."""
    frequent = _shared(docs, table, text_col, dictionary_units)
    names = [c for c in docs.columns if c not in MADE]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    return whole.mapInArrow(_encode(table, frequent, text_col), f"row {whole.schema['row'].dataType.simpleString()}, {_MADE_SQL}").select("row.*", *MADE)
