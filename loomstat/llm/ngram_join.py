"""N-gram Jaccard join by parity sketches: groups of documents that links of similarity 3/4 or more hold together.

A document is the set of its distinct shingles, as 64-bit hashes; sets that agree in two independent 64-bit sums are one
node from the start. |A xor B| is at most d = (|A| + |B|) / 7 for a linked pair, and bounds everything below.

* Join sketch. In a band of sizes (powers of two; a set near the next band takes part in both) every shingle toggles one
  bit of a long parity sketch: its hash picks a segment, and the bit within it out of 2^64. Such a sketch is nearly empty,
  so a segment is kept as the XOR of the hashes that fell into it, which names its set bits (toggled twice, a bit is gone
  from both). A shingle in one set alone changes one segment, so linked sets differ in at most d segments, and by the
  pigeonhole principle agree in all others: segments are the join key. A set sends its first d + 1 + X that are not empty
  in hash order, X = 0.12 |A|; linked sets then share at least 0.09 |A| + 1 of the sent ones.
* Sets that fill too few segments for that (small ones, now and then) send the first of their single shingles as well,
  where only such sets meet. No other set is touched by it.
* Only segments that two nodes share matter. Of these a node leaves out its 0.09 |A| most frequent ones (the two still
  share one): passages that many documents hold lose their segments here, and documents that have nothing else drop out.
* Within a segment's nodes no pairs are listed. First all are compared with one leader, the node with the most shared
  segments, and linked nodes become components. Then only nodes of different components are compared, the largest one with
  the rest, in blocks, by a short sketch (parity of four bits a shingle, whose Hamming distance is at most |A xor B|): each
  node's nearest is verified. Nodes of different components that may still be linked are compared in the same blocks on
  whole sets, and a block hands on a spanning forest of the links it finds, never more rows than it has nodes.

Links inside a component are not all listed; no link between components is missed. Within a pair two different shingles
would have to share one of 2^64 hashes to change a count.

Defined results: a text without words has 0 shingles and is linked with nothing; fewer words than a shingle are one
shingle; rows that repeat an id are documents of their own, copies or not; null ids never name a component unless it has
no other; very long texts are sets like others (about 16 bytes a word in a task); an empty table gives an empty table;
other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, one_row_each
from .textbytes import U64, folded, let_go, mix, slices, span_hashes

#: Nodes of one segment compared in one block; fewer where sets are large (see _block_size).
BLOCK = 1024
#: A segment with so many nodes in one slice of a task is frequent: the slice sends one of them to the segment's bin.
LOCAL = 32
#: Shingles whose segments are in a bin, which one task holds at a time (about 40 bytes each).
BIN = 2_000_000
#: Bytes of text whose segments are dealt to bins together.
SLICE = 1 << 21
#: Rows of (node, value) that may be broadcast (16 bytes each).
BROADCAST_NODES = 1_000_000
FREQUENT = 2**31 - 1
_SEED = U64(0xA0761D6478BD642F)
#: A node's roles are told apart by its lowest bits: own band, next band, single shingles.
_ROLES, _SINGLE = 3, 2


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text, one after the other, and where each text's begin and end."""
    n = len(offsets) - 1
    white = np.ones(len(data) + 2, bool)
    white[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(~white[1:-1] & (white[:-2] | cut[:-1]))
    end = np.flatnonzero(~white[1:-1] & (white[2:] | cut[1:])) + 1
    words = span_hashes(folded(data), start, end)
    first = np.searchsorted(start, offsets)
    count = np.diff(first)
    grams = np.zeros(max(0, len(words) - width + 1), U64)
    for k in range(width if len(grams) else 0):
        grams = mix(grams * _SEED + words[k : k + len(grams)])
    parts, sizes = [], np.zeros(n, np.int64)
    for i in range(n):
        a, c = first[i], count[i]
        if c >= width:
            own = np.sort(grams[a : a + c - width + 1])
            fresh = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            own = own[fresh]
        elif c:
            h = np.full(1, c, U64)
            for w in words[a : a + c]:
                h = mix(h * _SEED + w)
            own = h
        else:
            continue
        parts.append(own)
        sizes[i] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, U64), np.concatenate([[0], np.cumsum(sizes)])


def names_of(hashes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent sums of each set, 0 for an empty one. The two lowest bits of the first are 0, for the roles of a node."""
    size = np.diff(cuts)
    full = np.flatnonzero(size)
    out = np.zeros((2, len(size)), U64)
    for k, s in enumerate((_SEED, ~_SEED)):
        if len(full):
            out[k, full] = mix(np.add.reduceat(mix(hashes ^ s), cuts[full]) + size[full].astype(U64))
    one, two = out.view(np.int64)
    return one & ~_ROLES, two


def nodes_of(hashes: np.ndarray, cuts: np.ndarray, clashing: np.ndarray) -> np.ndarray:
    """The node of each set: its first sum, or the second where different sets share the first."""
    one, two = names_of(hashes, cuts)
    return np.where(np.isin(one, clashing), two & ~_ROLES, one)


def segments(own: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(role, segments sent) of a set: own band, the next band where the set is near it, single shingles where a band fails."""
    n = len(own)
    j = n.bit_length() - 1
    upper = 2 * n >= 3 << j
    # in its own band a set near the next one has only smaller partners left to meet
    bands = [(j, (n + (3 << j) // 2) // 7 if upper else n // 3)] + ([(j + 1, n // 3)] if upper else [])
    more, out, lack = 1 + 12 * n // 100, [], False
    for role, (band, d) in enumerate(bands):
        number = (11 * (1 << band)) // 10 + 8
        at = ((own >> U64(32)) * U64(number)) >> U64(32)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        got = np.bitwise_xor.reduceat(own, first)
        lack |= len(got) < d + more
        out.append((role, _tagged(got, band)[: d + more]))
    if lack:
        out.append((_SINGLE, _tagged(own, 99)[: n // 3 + more]))
    return out


def _tagged(values: np.ndarray, tag: int) -> np.ndarray:
    return mix(values ^ mix(np.full(1, tag + 1, U64) * _SEED))


def bit_sketch(own: np.ndarray) -> bytes:
    """Parity of the shingles of each bit: a power of two of bits, at least 64 and four a shingle."""
    bits = max(64, 1 << (4 * len(own) - 1).bit_length())
    odd = np.bincount((own & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return 100 * both >= 75 * (len(x) + len(y) - both)


def _profile(width: int):
    """(id, mark, one, two, n) of every text: its set's sums and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("ngram-join")
        for b in batches:
            for at, data, offsets in slices(b.column("text")):
                hashes, cuts = shingle_sets(data, offsets, width)
                one, two = names_of(hashes, cuts)
                n = np.diff(cuts)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, len(n)) for c in ("id", "mark")), pa.array(one), pa.array(two), pa.array(n)], ["id", "mark", "one", "two", "n"])

    return run


_BLOB = pa.schema([("bin", pa.int64()), ("hot", pa.bool_()), ("cells", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("runs", pa.binary()), ("among", pa.binary())])
_BLOB_SQL = "bin long, hot boolean, cells binary, nodes binary, sizes binary, runs binary, among binary"


def _blob(bin_: int, hot: bool, cell: np.ndarray, node: np.ndarray, n: np.ndarray, among: np.ndarray | None = None) -> dict:
    """Rows in order of node, its id once a run."""
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    return {"bin": bin_, "hot": hot, "cells": cell.tobytes(), "nodes": node[first].tobytes(), "sizes": n[first].astype("<i4").tobytes(), "runs": np.diff(np.append(first, len(node))).astype("<i4").tobytes(), "among": b"" if among is None else among.astype("<i4").tobytes()}


def _rows(r: dict) -> tuple[np.ndarray, ...]:
    runs = np.frombuffer(r["runs"], "<i4")
    return np.frombuffer(r["cells"], "<u8"), np.repeat(np.frombuffer(r["nodes"], "<i8"), runs), np.repeat(np.frombuffer(r["sizes"], "<i4"), runs)


def _dealt(where: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(where.astype(np.uint16) if len(where) and where.max() < 1 << 16 else where, kind="stable")
    found, at = np.unique(where[order], return_index=True)
    for k, s in zip(found, np.split(order, at[1:])):
        yield int(k), [c[s] for c in columns]


def _send(width: int, bins: int, clashing: np.ndarray):
    """A row a slice of texts and bin: the segments of the slice's nodes that belong to the bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("ngram-join")
        seen: set[int] = set()
        for b in batches:
            for _, data, offsets in slices(b.column("text"), SLICE):
                hashes, cuts = shingle_sets(data, offsets, width)
                keys = nodes_of(hashes, cuts, clashing).tolist()
                cell, node, size, runs = [], [], [], []
                for i in np.flatnonzero(np.diff(cuts)):
                    own, key = hashes[cuts[i] : cuts[i + 1]], keys[i]
                    if key in seen:  # a copy
                        continue
                    seen.add(key)
                    for role, got in segments(own):
                        cell.append(got)
                        node.append(key | role)
                        size.append(len(own))
                        runs.append(len(got))
                if not cell:
                    continue
                c, v, n = np.concatenate(cell), np.repeat(np.array(node, np.int64), runs), np.repeat(np.array(size, np.int64), runs)
                rows = []
                flat = np.sort(c)
                edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]]))
                often = flat[edge[:-1]][np.diff(edge) >= LOCAL]
                if len(often):
                    hot = np.isin(c, often)
                    for k, (cs, vs, ns) in _dealt((v[hot] >> 2) % bins, c[hot], v[hot], n[hot]):
                        rows.append(_blob(k, True, cs, vs, ns))
                    one = np.flatnonzero(hot)[np.unique(c[hot], return_index=True)[1]]
                    n[one] *= -1  # a size below 0: the segment is frequent
                    hot[one] = False
                    c, v, n = c[~hot], v[~hot], n[~hot]
                for k, (cs, vs, ns) in _dealt((c >> U64(20)).astype(np.int64) % bins, c, v, n):
                    for part in (ns > 0, ns < 0):
                        if part.any():
                            rows.append(_blob(k, False, cs[part], vs[part], ns[part]))
                yield pa.RecordBatch.from_pylist(rows, schema=_BLOB)

    return run


def _by_bin(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one bin after the other; they come in order of bin."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and held[-1]["bin"] != r["bin"]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _meet(bins: int):
    """The rows of segments that several nodes share, dealt anew to bins of nodes. All rows of a segment are in one bin, but
    for those that a slice passed on as frequent."""

    def out(cell: np.ndarray, node: np.ndarray, n: np.ndarray, among: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(node, kind="stable")
        cell, node, n, among = cell[order], node[order], n[order], among[order]
        rows = [_blob(k, False, *columns) for k, columns in _dealt((node >> 2) % bins, cell, node, n, among)]
        return pa.RecordBatch.from_pylist(rows, schema=_BLOB)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bin(batches):
            for r in rows:
                if r["hot"]:
                    cell, node, n = _rows(r)
                    yield out(cell, node, n, np.full(len(n), FREQUENT, np.int32))
            got = [_rows(r) for r in rows if not r["hot"]]
            if not got:
                continue
            cell, node, n = (np.concatenate(x) for x in zip(*got))
            got.clear()
            order = np.argsort(cell)
            alike = cell[order][1:] == cell[order][:-1]
            order = order[np.append(alike, False) | np.insert(alike, 0, False)]  # the others are of one row
            if not len(order):
                continue
            order = order[np.lexsort((n[order], node[order], cell[order]))]
            cell, node, n = cell[order], node[order], n[order]
            fresh = np.concatenate([[True], (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])])  # frequent (below 0) comes first
            cell, node, n = cell[fresh], node[fresh], n[fresh]
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            count = np.diff(np.append(first, len(cell)))
            often = np.minimum.reduceat(n, first) < 0
            among = np.repeat(np.where(often, FREQUENT, count), count)
            s = np.flatnonzero(among > 1)
            if len(s):
                yield out(cell[s], node[s], np.abs(n[s]), among[s])

    return run


def _rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, node, n, w): a node's shared segments without the most frequent ones; w is their number."""
    for rows in _by_bin(batches):
        cell, node, n = (np.concatenate(x) for x in zip(*map(_rows, rows)))
        among = np.concatenate([np.frombuffer(r["among"], "<i4") for r in rows])
        order = np.lexsort((cell, among, node))
        cell, node, n, among = cell[order], node[order], n[order], among[order]
        fresh = np.concatenate([[True], (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])])  # a frequent one comes from several tasks
        cell, node, n = cell[fresh], node[fresh], n[fresh]
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        count = np.diff(np.append(first, len(node)))
        nth = np.arange(len(node)) - np.repeat(first, count)
        left = np.repeat(count, count) - 9 * n.astype(np.int64) // 100
        s = np.flatnonzero(nth < left)
        for a in range(0, len(s), 100_000):
            k = s[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(cell[k].view(np.int64)), pa.array(node[k] & ~_ROLES), pa.array(n[k]), pa.array(left[k].astype(np.int32))], ["cell", "node", "n", "w"])


def _describe(width: int, clashing: np.ndarray):
    """(node, n, sketch, grams) of the texts asked for."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("sketch", pa.binary()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, data, offsets in slices(b.column("text")):
                hashes, cuts = shingle_sets(data, offsets, width)
                keys = nodes_of(hashes, cuts, clashing)
                sets = ((int(keys[i]), hashes[cuts[i] : cuts[i + 1]]) for i in np.flatnonzero(np.diff(cuts)))
                rows = [{"node": key, "n": len(own), "sketch": bit_sketch(own), "grams": own.tobytes()} for key, own in sets]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _fold(words: np.ndarray) -> np.ndarray:
    half = words.shape[1] // 2
    return words[:, :half] ^ words[:, half:]


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, na, sa, b, nb, sb): the pairs whose sketches let them be linked."""
    for b in batches:
        keep_ = []
        for na, sa, nb, sb in zip(*(b.column(c).to_pylist() for c in ("na", "sa", "nb", "sb"))):
            x, y = np.frombuffer(sa, U64)[None], np.frombuffer(sb, U64)[None]
            while x.shape[1] > y.shape[1]:
                x = _fold(x)
            while y.shape[1] > x.shape[1]:
                y = _fold(y)
            keep_.append(4 * min(na, nb) >= 3 * max(na, nb) and 7 * int(np.bitwise_count(x ^ y).sum()) <= na + nb)
        yield b.select(["a", "b"]).filter(pa.array(keep_, pa.bool_()))


def _allowed(n: np.ndarray, comp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    nx, ny = n[i].astype(np.int64), n[j].astype(np.int64)
    return (comp[i] != comp[j]) & (4 * np.minimum(nx, ny) >= 3 * np.maximum(nx, ny))


def _pairs(node: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, cut: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the rows of each block (between cuts) that are of different components, and of both sides where it has
    both. Small blocks are taken together, and what two nodes have in common there is looked at once."""
    size = np.diff(cut)
    held = []
    for s in np.unique(size[(size > 1) & (size <= 32)]):
        x, y = np.triu_indices(s, 1)
        first = cut[:-1][size == s]
        i, j = (first[:, None] + x).ravel(), (first[:, None] + y).ravel()
        # of a block with both sides, pairs across
        total = side[first[:, None] + np.arange(s)].sum(1)[:, None]
        mixed = np.broadcast_to((total > 0) & (total < s), (len(first), len(x))).ravel()
        ok = _allowed(n, comp, i, j) & (~mixed | (side[i] != side[j]))
        held.append(np.stack([i[ok], j[ok]]))
    if held:
        i, j = np.concatenate(held, 1)
        swap = node[i] > node[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        order = np.lexsort((node[j], node[i]))
        i, j = i[order], j[order]
        fresh = np.ones(len(i), bool)
        fresh[1:] = (node[i][1:] != node[i][:-1]) | (node[j][1:] != node[j][:-1])
        yield i[fresh], j[fresh]
    for k in np.flatnonzero(size > 32):
        a, z = int(cut[k]), int(cut[k + 1])
        both = side[a:z].any() and not side[a:z].all()
        for top in range(a, z, 64):
            i, j = (m.ravel() for m in np.meshgrid(np.arange(top, min(top + 64, z)), np.arange(a, z), indexing="ij"))
            ok = (i < j) & _allowed(n, comp, i, j)
            if both:
                ok &= side[i] != side[j]
            yield i[ok], j[ok]


def _near(n: np.ndarray, words: np.ndarray, at: np.ndarray, width: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
    """(i, j, distance) of the pairs that the sketches let by: words[at:at + width] of each row, widths powers of two."""
    wide = width[i] < width[j]
    i, j = np.where(wide, j, i), np.where(wide, i, j)
    out = []
    for w, v in np.unique(np.stack([width[i], width[j]]), axis=1).T if len(i) else ():
        of = np.flatnonzero((width[i] == w) & (width[j] == v))
        step = max(1, 1_000_000 // int(w))
        for k in range(0, len(of), step):
            p, q = i[of[k : k + step]], j[of[k : k + step]]
            x = words[at[p][:, None] + np.arange(w)]
            while x.shape[1] > v:
                x = _fold(x)
            far = np.bitwise_count(x ^ words[at[q][:, None] + np.arange(v)]).sum(1, dtype=np.int64)
            ok = 7 * far <= n[p].astype(np.int64) + n[q]
            out.append((p[ok], q[ok], far[ok]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _nearest(node: np.ndarray, comp: np.ndarray, near: Iterator[tuple[np.ndarray, ...]], _: pa.Table) -> list[tuple[int, int]]:
    """Each node's nearest of another component."""
    best: dict[int, tuple[int, int]] = {}
    for i, j, far in near:
        for who, other in ((i, j), (j, i)):
            order = np.lexsort((far, node[who]))
            key = node[who][order]
            first = order[np.concatenate([[True], key[1:] != key[:-1]])] if len(order) else order
            for k, f, o in zip(node[who[first]].tolist(), far[first].tolist(), node[other[first]].tolist()):
                if k not in best or f < best[k][0]:
                    best[k] = (f, o)
    return [(k, o) for k, (_, o) in best.items()]


def _forest(node: np.ndarray, comp: np.ndarray, near: Iterator[tuple[np.ndarray, ...]], rows: pa.Table) -> list[tuple[int, int]]:
    """Links between components, verified on whole sets: a spanning forest of all that blocks have."""
    parent = {int(c): int(c) for c in np.unique(comp)}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out, grams = [], rows["grams"]
    for i, j, _ in near:
        for p, q in zip(i.tolist(), j.tolist()):
            a, b = root(int(comp[p])), root(int(comp[q]))
            if a != b and linked(np.frombuffer(grams[p].as_buffer(), U64), np.frombuffer(grams[q].as_buffer(), U64)):
                parent[a] = b
                out.append((int(node[p]), int(node[q])))
    return out


def _in_blocks(find):
    """Rows (cell, i, j, side, node, n, comp, sketch, grams) in order of (cell, i, j); find says which pairs to hand on."""

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        key = np.stack([t[c].to_numpy() for c in ("cell", "i", "j")])
        cut = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0), [True]]))
        node, n, comp, side = (t[c].to_numpy() for c in ("node", "n", "comp", "side"))
        sketch = t["sketch"].to_pylist()
        width = np.array([len(x) // 8 for x in sketch])
        words, at = np.frombuffer(b"".join(sketch), U64), np.cumsum(width) - width
        near = (_near(n, words, at, width, i, j) for i, j in _pairs(node, n, comp, side, cut))
        p = np.sort(np.array(find(node, comp, near, t), np.int64).reshape(-1, 2).T, 0)
        p = np.unique(p, axis=1) if p.shape[1] else p
        return pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            key = np.stack([b.column(c).to_numpy() for c in ("cell", "i", "j")])
            change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
            # the last block of a batch may go on in the next
            if held and (np.array([held[-1].column(c)[-1].as_py() for c in ("cell", "i", "j")]) != key[:, 0]).any():
                yield flush(held)
                held = []
            if len(change):
                last = int(change[-1]) + 1
                yield flush([*held, b.slice(0, last)])
                held = []
                b = b.slice(last)
            held.append(b)
        if held:
            yield flush(held)

    return run


def _open_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b): each once, as a and as b."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column("a"), b.column("b")]).unique()], ["node"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, ga, gb): the pairs whose whole sets are linked."""
    for b in batches:
        keep_ = [linked(np.frombuffer(ga.as_buffer(), U64), np.frombuffer(gb.as_buffer(), U64)) for ga, gb in zip(b.column("ga"), b.column("gb"))]
        yield b.select(["a", "b"]).filter(pa.array(keep_, pa.bool_()))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a written table of two numbers a row where its count shows that it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_NODES else df


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of links(a, b); comp is one node of each component.

    Each node points to its least neighbour, pointers are followed once more, and what points to one node is drawn
    together: the links left between such groups are the next, smaller turn."""
    edges = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct(), "edges")
    maps = []
    while not edges.isEmpty():
        low = keep(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("low")), "pointers")
        next_ = low.select(F.col("node").alias("low"), F.col("low").alias("comp"))
        maps.append(keep(low.join(next_, "low").select("node", "comp"), "labels"))
        x, y = (maps[-1].select(F.col("node").alias(k), F.col("comp").alias(f"{k}_comp")) for k in "ab")
        drawn = edges.join(x, "a").join(y, "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
        edges = keep(drawn.where(F.col("a") != F.col("b")).distinct(), "edges")
    return _composed(maps) if maps else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def _composed(maps: list[DataFrame]) -> DataFrame:
    """(node, comp) of labels of nodes, labels of these labels, and so on."""
    out = maps[0]
    for m in maps[1:]:
        out = out.join(m.select(F.col("node").alias("comp"), F.col("comp").alias("above")), "comp", "left").select("node", F.coalesce("above", "comp").alias("comp"))
    return keep(out, "labels")


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp with more links between its components, or with nodes outside them, drawn together."""
    ends = links.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    more = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    fresh = more.join(comp.select("node"), "node", "left_anti")
    return _composed([comp.unionByName(fresh), more])


def _salt(name: str, salts: int = 16):
    return F.pmod(F.xxhash64(F.col(name)), F.lit(salts)).cast("int").alias("salt")


def _salted(salts: int = 16):
    return F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")


def row_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """Per row of docs: id, mark (MD5 of the text), n (shingles), group (least id that links reach), first (the mark of that row)."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("mark", F.md5("text"))
    seen = keep(base.mapInArrow(_profile(width), "id long, mark string, one long, two long, n long"), "profiles")
    # the least row of a node: least id, null last, then least mark
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    nodes = keep(seen.where(F.col("n") > 0).groupBy("one", "two", "n").agg(F.min(rank).alias("least"), F.count(F.lit(1)).alias("copies")), "nodes")
    # first sums of different sets: of 5e10 sets about 300 are expected to share one
    clashing = [r["one"] for r in nodes.groupBy("one").count().where(F.col("count") > 1).collect()]
    bad = F.col("one").isin(clashing) if clashing else F.lit(False)
    node = F.when(bad, F.col("two").bitwiseAND(~_ROLES)).otherwise(F.col("one"))
    nodes = nodes.select(node.alias("node"), "least", "copies", "n")
    comps = _components_of(base, nodes, width, np.array(clashing, np.int64))
    # only nodes with copies or links need a join back; rows of a hot component or node are dealt to several salts
    whole = nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = whole.groupBy("comp").agg(F.min("least").alias("group"), F.sum("copies").alias("size")).where(F.col("size") > 1)
    named = whole.select("node", "comp", _salt("node")).join(least.select("comp", "group", _salted()), ["comp", "salt"]).select("node", "group", _salted())
    named = keep(named, "components")
    rows = seen.select("id", "mark", "n", node.alias("node")).withColumn("salt", _salt("mark"))
    out = rows.join(named, ["node", "salt"], "left")
    alone = F.col("group").isNull()
    return out.select("id", "mark", "n", F.when(alone, F.col("id")).otherwise(F.col("group.id")).alias("group"), F.when(alone, F.col("mark")).otherwise(F.col("group.mark")).alias("first"))


def linked_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """Per row of docs: id_col, n_shingles, component_id (the least id that links reach)."""
    return row_groups(docs, id_col, text_col, width).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("group", "id").alias("component_id"))


def _kept_segments(base: DataFrame, nodes: DataFrame, width: int, clashing: np.ndarray) -> DataFrame:
    """(cell, node, n, w) of the segments that nodes keep. The shuffles behind it are let go: they hold more than all that follows."""
    spark = base.sparkSession
    total = nodes.agg(F.sum("n")).first()[0] or 0
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BIN)
    sent = base.mapInArrow(_send(width, bins, clashing), _BLOB_SQL).repartition("bin").sortWithinPartitions("bin")
    shared = sent.mapInArrow(_meet(bins), _BLOB_SQL).repartition("bin").sortWithinPartitions("bin")
    left = keep(shared.mapInArrow(_rarest, "cell long, node long, n int, w int"), "kept-segments")
    del sent, shared
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # files of a shuffle go when the driver no longer knows it
    return left


def _components_of(base: DataFrame, nodes: DataFrame, width: int, clashing: np.ndarray) -> DataFrame:
    """(node, comp) of the nodes that have links, all of them verified."""
    left = _kept_segments(base, nodes, width, clashing)
    lead = left.groupBy("cell").agg(F.max(F.struct("w", "node")).alias("top"), F.count(F.lit(1)).alias("g")).where(F.col("g") > 1).select("cell", F.col("top.node").alias("leader"))
    # segments that one node alone has are of no further use: what follows reads the others only
    met = keep(left.select("cell", "node", "n").join(lead.hint("merge"), "cell"), "met-segments")
    pairs = met.where(F.col("node") != F.col("leader"))
    star = keep(pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), "stars")
    ends = star.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen = keep(ends.join(nodes, "node").select("node", F.col("least.id").alias("id"), F.col("least.mark").alias("mark")), "candidates")
    if chosen.isEmpty():
        return chosen.select("node", F.col("node").alias("comp"))
    wanted = _small(chosen.select("id").distinct())
    texts = base.join(wanted, base["id"].eqNullSafe(wanted["id"]), "left_semi")
    told = texts.mapInArrow(_describe(width, clashing), "node long, n int, sketch binary, grams binary")
    told = keep(told.join(_small(chosen.select("node")), "node", "left_semi").dropDuplicates(["node"]), "candidate-sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = keep(pairs, "pairs")
        ends = _small(pairs.mapInArrow(_open_nodes, "node long").distinct())
        a = told.join(ends, "node", "left_semi").select(F.col("node").alias("a"), F.col("grams").alias("ga"))
        b = a.select(F.col("a").alias("b"), F.col("ga").alias("gb"))
        return keep(pairs.join(a, "a").join(b, "b").select("a", "b", "ga", "gb").mapInArrow(_verify, "a long, b long"), name)

    a = told.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = told.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    links = verified(star.join(a, "a").join(b, "b").mapInArrow(_near_pairs, "a long, b long"), "links")
    comp = components(links)
    split = _blocks(met.drop("leader"), comp)
    near = _found(split, told, _nearest, False)
    if near.isEmpty():
        return comp
    some = keep(near.mapInArrow(_open_nodes, "node long").distinct(), "open-nodes")
    more = verified(near, "links")
    if not more.isEmpty():
        comp = _joined(comp, more)
    # nodes that have a near one of another component take part with their whole sets
    some = _small(some)
    more = _found(_fewer_blocks(split.join(some, "node", "left_semi"), comp), told.join(some, "node", "left_semi"), _forest, True)
    return comp if more.isEmpty() else _joined(comp, more)


def _found(split: DataFrame, told: DataFrame, find, whole: bool) -> DataFrame:
    more = ["sketch", "grams"] if whole else ["sketch"]
    rows = split.join(told.select("node", *more), "node").select("cell", "i", "j", "side", "node", "n", "comp", *more)
    dealt = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return keep(dealt.mapInArrow(_in_blocks(find), "a long, b long").distinct(), "near-pairs")


def _fewer_blocks(split: DataFrame, comp: DataFrame) -> DataFrame:
    """split, what is left of each block, with components as they are now: without blocks of one component, and one of the
    blocks that hold the same nodes (by two hashes of them). All pairs of a block are looked at, whatever their sides."""
    rows = split.drop("comp", "side").join(_small(comp), "node", "left").withColumn("comp", F.coalesce("comp", "node")).withColumn("side", F.lit(0))
    names = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"f{k}") for k in (0, 1)]
    each = rows.groupBy("cell", "i", "j").agg(F.count(F.lit(1)).alias("all"), F.min("comp").alias("low"), F.max("comp").alias("high"), *names).where(F.col("low") != F.col("high"))
    one = each.groupBy("f0", "f1", "all").agg(F.min(F.struct("cell", "i", "j")).alias("x")).select("x.*")
    return keep(rows.join(one, ["cell", "i", "j"]), "open-again")


def _blocks(left: DataFrame, comp: DataFrame) -> DataFrame:
    """(cell, i, j, side, node, n, comp) of the segments that hold several components, dealt to blocks so that each two
    nodes of different components meet in one. A segment that outgrows a block has its largest component on one side, and
    all others on the other side and among themselves; the largest is not compared with itself."""
    rows = left.join(_small(comp), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"f{k}") for k in (0, 1)]
    each = rows.groupBy("cell", "comp").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), *names)
    size = F.least(F.lit(BLOCK), F.greatest(F.lit(64), F.floor(F.lit(1 << 22) / F.max("n"))))
    cells = each.groupBy("cell").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("comps"), size.alias("size"), *[F.bit_xor(f"f{k}").alias(f"f{k}") for k in (0, 1)]).where(F.col("comps") > 1)
    # of segments with the same nodes (by two hashes of them) one will do
    cells = cells.groupBy("f0", "f1", "all").agg(F.min(F.struct("cell", "top", "size")).alias("x")).select("x.*", "all")
    chunks = lambda c: F.ceil(c / F.col("size")).cast("int")
    one = F.col("all") <= F.col("size")
    cells = cells.select("cell", F.when(one, F.lit(None)).otherwise(F.col("top.comp")).alias("main"), F.when(one, 1).otherwise(chunks(F.col("top.c"))).alias("nm"), F.when(one, 1).otherwise(chunks(F.col("all") - F.col("top.c"))).alias("nr"), one.alias("single"))
    rows = rows.join(cells.hint("merge"), "cell")
    h = F.xxhash64("node")
    own = F.pmod(h, F.col("nr")).cast("int")
    to = lambda n: F.sequence(F.lit(0), n - 1)
    block = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    main = F.transform(to(F.col("nr")), lambda j: block(F.pmod(h, F.col("nm")), j, F.lit(0)))
    rest = F.concat(
        F.transform(to(F.col("nm")), lambda i: block(i, own, F.lit(1))),
        F.transform(to(F.col("nr")), lambda k: block(F.col("nm") + F.least(own, k), F.greatest(own, k), own > k)),
    )
    alone = F.array(block(F.lit(0), F.lit(0), F.lit(0)))
    where = F.when(F.col("single"), alone).when(F.col("comp") == F.col("main"), main).otherwise(rest)
    return keep(rows.select("cell", "node", "n", "comp", F.explode(where).alias("b")).select("cell", "b.i", "b.j", "b.side", "node", "n", "comp"), "open-segments")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """docs with one row of each component, that of the least id (null last), then least MD5 of the text; all columns stay.
    Rows are told apart by id and text, so rows that repeat an id with other texts are judged one by one; of rows that
    repeat both, one stays."""
    rows = row_groups(docs, id_col, text_col, width)
    return one_row_each(docs, rows.select("id", "mark", (F.col("id").eqNullSafe(F.col("group")) & (F.col("mark") == F.col("first"))).alias("stays")), id_col, text_col)
