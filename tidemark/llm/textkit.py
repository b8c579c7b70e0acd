"""Vectorised text kernels shared by the corpus operators.

Every function here works on one slice of an Arrow string column: the UTF-8
bytes of several documents laid end to end, and the offsets between them.
Nothing loops over characters or words in Python.  Words are runs of bytes
other than space and 0x09-0x0D; those bytes never occur inside a multi-byte
UTF-8 sequence, so byte positions are word positions.

Hashes are 64-bit: eight bytes at a time are mixed into a state, and ranges of
more than LONG bytes go through BLAKE2.  No step is linear in the text, so no
family of strings collides by its form.  Where an answer depends on equality,
equal hashes are followed by a comparison of the bytes (`Hasher.same`).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single document is its own slice.
SLICE_BYTES = 1 << 20
#: Longer byte ranges are hashed one by one.
LONG = 256

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD6E8FEB86659FD93)
_MIX1 = _U(0xBF58476D1CE4E5B9)
_MIX2 = _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(batch: pa.RecordBatch, column: str = "text"):
    """Yield (rows, data, offsets) over a batch: the rows as a RecordBatch, the
    text bytes and where each row's bytes begin and end.  Null is empty.  The
    column may be a field of a struct column, as `struct.field`."""
    outer, _, inner = column.partition(".")
    text = batch.column(batch.schema.get_field_index(outer))
    if inner:
        text = pc.struct_field(text, inner)
    if text.null_count:
        text = text.fill_null(b"" if pa.types.is_binary(text.type) or pa.types.is_large_binary(text.type) else "")
    large = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(text):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[end])
        yield batch.slice(row, end - row), data[lo:hi], offsets[row : end + 1] - lo
        row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each document the index of its
    first word (one entry more than documents)."""
    inside = ~_SPACE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Hasher:
    """Hashes and exact comparisons of byte ranges of one slice."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        self._view(data, padded)

    @classmethod
    def over(cls, padded: np.ndarray) -> Hasher:
        """Over all but the last eight bytes of an array, without a copy."""
        out = cls.__new__(cls)
        out._view(padded[:-8], padded)
        return out

    def _view(self, data: np.ndarray, padded: np.ndarray) -> None:
        self.data = data
        # the eight bytes that begin at any byte
        self._lanes = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))

    def _lane(self, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
        return self._lanes[starts] & _LOW_BYTES[np.minimum(left, 8)]

    def of(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        size = ends - starts
        out = mix((size.astype(_U) + _U(seed + 1)) * _BASE)
        short = size <= LONG
        open_, k = np.flatnonzero(short & (size > 0)), 0
        while len(open_):
            left = size[open_] - k
            out[open_] = mix(out[open_] * _STEP ^ self._lane(starts[open_] + k, left))
            open_, k = open_[left > 8], k + 8
        for i in np.flatnonzero(~short).tolist():
            digest = hashlib.blake2b(self.data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
            out[i] = int.from_bytes(digest, "little")
        return out

    def same(self, starts: np.ndarray, ends: np.ndarray, other: Hasher, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
        """Whether each range equals, byte by byte, the other slice's range."""
        size = ends - starts
        out = size == other_ends - other_starts
        open_, k = np.flatnonzero(out & (size > 0) & (size <= LONG)), 0
        while len(open_):
            left = size[open_] - k
            equal = self._lane(starts[open_] + k, left) == other._lane(other_starts[open_] + k, left)
            out[open_[~equal]] = False
            open_, k = open_[equal & (left > 8)], k + 8
        for i in np.flatnonzero(out & (size > LONG)).tolist():
            out[i] = np.array_equal(self.data[starts[i] : ends[i]], other.data[other_starts[i] : other_ends[i]])
        return out

    def classes(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of equal ranges: hash and one range of each class, and the
        class of every range.  Unequal ranges of one hash are classes apart."""
        keys, one, which = np.unique(self.of(starts, ends), return_index=True, return_inverse=True)
        unequal = np.flatnonzero(~self.same(starts, ends, self, starts[one][which], ends[one][which]))
        if len(unequal):
            known: dict[bytes, int] = {}
            more_keys, more = [], []
            for i in unequal.tolist():
                text = self.data[starts[i] : ends[i]].tobytes()
                if text not in known:
                    known[text] = len(keys) + len(more)
                    more_keys.append(keys[which[i]])
                    more.append(i)
                which[i] = known[text]
            keys, one = np.concatenate([keys, np.array(more_keys, _U)]), np.concatenate([one, more])
        return keys, one, which


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` neighbouring hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for k in range(width):
        out = (out + hashes[k : k + n]) * _BASE
        out ^= out >> _U(29)
    return mix(out)


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of `mask` are set between neighbouring offsets."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def in_document(hashes: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal hashes of the same document."""
    return mix(hashes ^ mix((document.astype(_U) + _U(1)) * _MIX1))


class Shingles:
    """The distinct `width`-word shingles of the documents of a slice, A-Z in
    lower case; of a document with fewer words its whole word sequence."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        data = lower_ascii(data)
        self.width = width
        self.starts, self.ends, self.first = words(data, offsets)
        self.hasher = Hasher(data)
        self.hashes = self.hasher.of(self.starts, self.ends)
        self.keys = windows(self.hashes, width)

    def __len__(self) -> int:
        return len(self.first) - 1

    def length(self, d: int) -> int:
        """Words of each shingle of a document."""
        return min(self.width, int(self.first[d + 1] - self.first[d]))

    def set_of(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes in order, and the first word of each shingle."""
        a, b = int(self.first[d]), int(self.first[d + 1])
        if b - a < self.width:
            return windows(self.hashes[a:b], b - a) if b > a else np.zeros(0, _U), np.arange(a, a + (b > a))
        keys = self.keys[a : b - self.width + 1]
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        if not new.all():
            at = order + a
            again = np.flatnonzero(~new)
            for i in again[~self.same(self.width, at[again], self, at[again - 1])].tolist():
                # unequal shingles of one hash: compare with all of that hash
                k = i - 1
                while k >= 0 and ordered[k] == ordered[i] and not self.same(self.width, at[i : i + 1], self, at[k : k + 1])[0]:
                    k -= 1
                new[i] = k < 0 or ordered[k] != ordered[i]
        return ordered[new], order[new] + a

    def same(self, length: int, at: np.ndarray, other: Shingles, other_at: np.ndarray) -> np.ndarray:
        """Whether the `length` words from each place are the same, byte by byte."""
        out = np.ones(len(at), bool)
        for k in range(length):
            out &= self.hasher.same(self.starts[at + k], self.ends[at + k], other.hasher, other.starts[other_at + k], other.ends[other_at + k])
        return out

    def second(self, d: int, at: np.ndarray) -> np.ndarray:
        """Another, independent hash of the shingles at these places."""
        if not hasattr(self, "_second"):
            self._second = self.hasher.of(self.starts, self.ends, 1)
        length, out = self.length(d), np.zeros(len(at), _U)
        for k in range(length):
            out = mix(out * _STEP + self._second[at + k])
        return out


_TRAILING = np.zeros(256, bool)
_TRAILING[[ord(c) for c in ".,;:!?%$&*#"]] = True
_ALNUM = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _ALNUM[_lo:_hi] = True


def split_trailing(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where each byte range's closing run of plain punctuation begins, if the
    character before the run is surely a letter or digit; else the range's end.
    Pre-tokenizers by Unicode class always cut at that place."""
    if not len(starts):
        return ends
    last = np.where(_TRAILING[data], -1, np.arange(len(data)))
    np.maximum.accumulate(last, out=last)
    cut = np.maximum(last[ends - 1] + 1, starts)
    before = data[np.maximum(cut - 1, 0)]
    latin = (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (cut - starts >= 2) & (data[np.maximum(cut - 2, 0)] == 0xC3)
    return np.where((cut > starts) & (_ALNUM[before] | latin), cut, ends)
