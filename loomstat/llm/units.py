"""Byte-level BPE by units: runs of text between places where the encoder must start afresh.

A place between a character that is no white space and a following space is a token boundary whatever stands left or
right of it: no pre-token of the byte-level pattern holds white space behind other characters, and the pattern never
looks back. So the ids of a text are the ids of its units, one after the other, and a worker encodes equal units once.
Units are equal when two independent 64-bit hashes are; a clash of one of them alone is seen, and other hashes are taken.
"""

from __future__ import annotations

import os

import numpy as np

from .textbytes import ranges, span_hashes

#: Units remembered by a worker (about 25 bytes each); beyond it the memory is emptied and filled anew.
CACHE_UNITS = 1_500_000

_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder a worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def boundaries(data: np.ndarray) -> np.ndarray:
    """Positions of spaces that follow a character that is no white space (Unicode's white space and U+001C to U+001F)."""
    at = np.flatnonzero(data == 32)
    at = at[at > 0]
    last = data[at - 1]
    white = (last <= 32) & (((last >= 9) & (last <= 13)) | (last >= 28))
    wide = np.flatnonzero((last >= 0x80) & (last < 0xC0))
    second, third = data[at[wide] - 2], data[np.maximum(at[wide] - 3, 0)]
    white[wide] |= ((second == 0xC2) & ((last[wide] == 0x85) | (last[wide] == 0xA0))) | ((third >= 0xE1) & (third <= 0xE3) & ((second == 0x9A) | (second == 0x80) | (second == 0x81)))
    return at[~white]


class UnitEncoder:
    """Ids of texts as the tokenizers library gives them for a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.type = np.dtype("<u2") if self.lib.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        vocab = self.lib.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.seed = 0
        self._forget()

    def _forget(self) -> None:
        self.keys, self.proof = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool: np.ndarray = np.zeros(1 << 16, self.type)
        self.used = 0

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.type) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, proof: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Units that open with their only space are encoded side by side and told apart by the ids that open with a space."""
        got, sizes = [], np.zeros(len(keys), np.int32)
        odd = np.concatenate([[0], np.cumsum((data <= 32) | (data == 60) | (data >= 0xC2) & (data <= 0xE3) & (data != 0xC3))])
        plain = (data[start] == 32) & (odd[end] - odd[start] == 1) & (end - start > 1)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        k = int(plain.sum())
        rest = order[k:]
        for a in range(0, k, 2000):
            some = order[a : min(a + 2000, k)]
            ids = self._encode([data[ranges(start[some], end[some] - start[some])].tobytes().decode()])[0]
            first = np.flatnonzero(self.opens[ids])
            if len(first) == len(some):
                sizes[some] = np.diff(np.append(first, len(ids)))
            else:
                each = self._encode([data[i:j].tobytes().decode() for i, j in zip(start[some], end[some])])
                sizes[some] = [len(x) for x in each]
                ids = np.concatenate(each)
            got.append(ids)
        each = self._encode([data[i:j].tobytes().decode() for i, j in zip(start[rest], end[rest])])
        sizes[rest] = [len(x) for x in each]
        got += each
        new = np.concatenate(got) if got else np.zeros(0, self.type)
        if self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(new), len(self.pool)), self.type)])
        self.pool[self.used : self.used + len(new)] = new
        at = np.zeros(len(keys), np.int64)
        at[order] = self.used + np.cumsum(sizes[order]) - sizes[order]
        self.used += len(new)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.proof = np.insert(self.keys, place, keys), np.insert(self.proof, place, proof)
        self.at, self.n = np.insert(self.at, place, at), np.insert(self.n, place, sizes)

    def lookup(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Units of the texts data[offsets[i]:offsets[i + 1]]: byte start, place of their ids in the pool, number of ids; and each text's first unit."""
        if len(self.keys) > CACHE_UNITS:
            self._forget()
        opens = np.zeros(len(data) + 1, bool)
        opens[boundaries(data)] = opens[offsets] = True
        start = np.flatnonzero(opens[:-1])
        end = np.append(start[1:], len(data)) if len(start) else start
        while True:
            hashes, proofs = (span_hashes(data, start, end, self.seed + k) for k in (0, 1))
            keys, one, back = np.unique(hashes, return_index=True, return_inverse=True)
            place = np.searchsorted(self.keys, keys)
            new = np.ones(len(keys), bool)
            old = np.flatnonzero(place < len(self.keys))
            new[old] = self.keys[place[old]] != keys[old]
            known = ~new
            same = (self.proof[place[known]] == proofs[one[known]]).all() and (proofs[one][back] == proofs).all()
            if same:
                break
            self.seed += 2  # two units share a hash: begin anew with other ones
            self._forget()
        if new.any():
            self._learn(keys[new], proofs[one[new]], data, start[one[new]], end[one[new]])
            place = np.searchsorted(self.keys, keys)
        return start, self.at[place][back], self.n[place][back], np.searchsorted(start, offsets)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        _, _, n, first = self.lookup(data, offsets)
        return np.diff(np.concatenate([[0], np.cumsum(n)])[first])

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin and end."""
        _, at, n, first = self.lookup(data, offsets)
        return self.pool[ranges(at, n)], np.concatenate([[0], np.cumsum(n)])[first]
