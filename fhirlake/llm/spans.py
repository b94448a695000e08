"""Hashes of byte ranges of many texts at once, for numpy inside tasks."""

from __future__ import annotations

import ctypes
import functools
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SEED = 20240711
U = np.uint64


def process_cache() -> dict:
    """Survives between the tasks of one Python worker."""
    return sys.modules.setdefault("_fhirlake_llm_cache", types.ModuleType("_fhirlake_llm_cache")).__dict__


def releasing(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task that ends by giving free memory back to the system: its worker stays for other tasks and other stages."""

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and where each text begins; no copy."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, starts.astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-known 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class RangeHash:
    """64-bit hashes of any ranges of a byte array, each in constant time after one pass.

    A polynomial over random values of the bytes, modulo 2^64, from prefix sums.
    """

    def __init__(self, raw: np.ndarray, salt: int = 0) -> None:
        values, powers, inverse = self._tables(len(raw), salt)
        self.inverse = inverse
        self.sums = np.zeros(len(raw) + 1, U)
        product = values[raw]
        product *= powers[: len(raw)]
        np.cumsum(product, out=self.sums[1:])

    @staticmethod
    def _tables(n: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cache = process_cache()
        have = cache.get(("range-hash", salt))
        if have is None or len(have[1]) < n:
            rng = np.random.default_rng(SEED + salt)
            values = rng.integers(0, 1 << 64, 256, U)
            base = int(rng.integers(0, 1 << 63)) * 2 + 1
            size = max(1 << 20, 1 << int(max(n, 1) - 1).bit_length())
            have = values, _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
            cache[("range-hash", salt)] = have
        return have

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends] - self.sums[starts]
        h *= self.inverse[starts]
        return mix(h ^ (ends - starts).astype(U))


def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(size, U)
    done = 1
    while done < size:
        step = U(pow(base, done, 1 << 64))
        more = min(done, size - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out


def groups(starts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive texts with about `most` bytes together: (first, after the last)."""
    first, n = 0, len(starts) - 1
    while first < n:
        after = int(np.searchsorted(starts, starts[first] + most, "right")) - 1
        after = min(max(after, first + 1), n)
        yield first, after
        first = after


BLANK = 32
#: Texts are handled in runs of about so many bytes, to bound a task's memory.
RUN_BYTES = 1 << 20


class Shingles:
    """Runs of `width` words of normal texts (see `shingling.normal`): all texts of one byte array.

    A text of fewer words is one shingle; a text without words has none.
    """

    def __init__(self, raw: np.ndarray, starts: np.ndarray, width: int) -> None:
        base = int(starts[0])
        raw = raw[base : int(starts[-1])]
        starts = starts - base
        blank = raw == BLANK
        begins = np.zeros(len(raw) + 1, bool)
        begins[1:][blank] = True
        begins[starts[:-1][np.diff(starts) > 0]] = True
        ends = np.zeros(len(raw) + 1, bool)
        ends[:-1][blank] = True
        ends[starts[1:][np.diff(starts) > 0]] = True
        # without blanks at the borders and without double blanks, each begin has its end
        word_start, word_end = np.flatnonzero(begins), np.flatnonzero(ends)
        per_text = np.diff(np.searchsorted(word_start, starts))
        self.words = per_text
        self.word_start, self.word_end = word_start, word_end
        self.first_word = np.cumsum(per_text) - per_text
        self.counts = np.where(per_text == 0, 0, np.maximum(per_text - width + 1, 1))
        self.owner = np.repeat(np.arange(len(per_text)), self.counts)
        within = np.arange(len(self.owner)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        first = np.repeat(self.first_word, self.counts) + within
        last = np.minimum(first + width, np.repeat(self.first_word + per_text, self.counts)) - 1
        self.place = within
        self.hasher = RangeHash(raw)
        self.hashes = self.hasher(word_start[first], word_end[last])


def occurrences(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, number) sorted by owner and hash; the number counts equal hashes of an owner from 0."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    run = np.flatnonzero(new)
    number = np.arange(len(owner)) - np.repeat(run, np.diff(np.append(run, len(owner))))
    return owner, hashes, number


def multiset(hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """One distinct value per occurrence: multisets compare as sets do."""
    return mix(hashes + number.astype(U) * U(0x9E3779B97F4A7C15))
