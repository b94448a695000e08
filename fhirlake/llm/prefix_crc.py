"""Running CRC-32 values of many texts at once, and the CRC of any part of a text from two of them.

The CRC register is linear over GF(2): reading n zero bytes is a linear map of the register, so the register after
a..b equals the one after b minus (xor) the one at a, carried over the bytes between. For numpy inside tasks.
"""

from __future__ import annotations

import numpy as np

from fhirlake.llm.spans import process_cache

U = np.uint32
_ONES = U(0xFFFFFFFF)
# Fixed value: the reversed polynomial of the standard CRC-32.
_POLYNOMIAL = 0xEDB88320
#: Texts are scanned as rows of so many bytes, all rows at once.
WIDTH_POWER = 9
WIDTH = 1 << WIDTH_POWER


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=U)
    for _ in range(8):
        table = np.where(table & U(1), (table >> U(1)) ^ U(_POLYNOMIAL), table >> U(1))
    return table


def _shift_tables(power: int) -> np.ndarray:
    """Four tables, by byte of the register, of the map that reading 2**power zero bytes is."""
    table = process_cache().setdefault("crc-bytes", _byte_table())
    one = np.zeros((4, 256), U)
    for k in range(4):
        register = np.arange(256, dtype=U) << U(8 * k)
        one[k] = table[register & U(255)] ^ (register >> U(8))
    for _ in range(power):
        one = np.stack([_apply(one, one[k]) for k in range(4)])
    return one


def _apply(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    out = tables[0][register & U(255)]
    for k in range(1, 4):
        out ^= tables[k][(register >> U(8 * k)) & U(255)]
    return out


def _tables(power: int) -> np.ndarray:
    cache = process_cache()
    if ("crc-shift", power) not in cache:
        cache["crc-shift", power] = _shift_tables(power)
    return cache["crc-shift", power]


def shifted(register: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The registers after so many zero bytes each."""
    out = register.astype(U)
    for power in range(int(lengths.max(initial=0)).bit_length()):
        some = np.flatnonzero((lengths >> power) & 1)
        out[some] = _apply(_tables(power), out[some])
    return out


def running(raw: np.ndarray) -> np.ndarray:
    """The register (from 0, without the final complement) before each byte and after the last.

    Rows of WIDTH bytes are scanned side by side from 0; each row's start, found by prefix sums over the rows' ends, is
    then carried into it.
    """
    n = len(raw)
    table = process_cache().setdefault("crc-bytes", _byte_table())
    rows = -(-max(n, 1) // WIDTH)
    grid = np.zeros((WIDTH, rows), np.uint8)  # by column, so that a step reads consecutive bytes
    padded = np.zeros(rows * WIDTH, np.uint8)
    padded[:n] = raw
    grid[:] = padded.reshape(rows, WIDTH).T
    out = np.empty((WIDTH + 1, rows), U)
    out[0] = 0
    for column in range(WIDTH):
        before = out[column]
        out[column + 1] = table[(before ^ grid[column]) & U(255)] ^ (before >> U(8))
    ends = out[WIDTH].copy()
    for power in range((rows - 1).bit_length()):  # prefix sums over the rows, by doubling
        reach = 1 << power
        ends[reach:] ^= _apply(_tables(WIDTH_POWER + power), ends[:-reach].copy())
    carried = np.append(U(0), ends[:-1])
    for column in range(WIDTH):
        out[column] ^= carried
        carried = table[carried & U(255)] ^ (carried >> U(8))
    flat = out[:WIDTH].T.reshape(-1)
    last = out[n - (rows - 1) * WIDTH] if n < rows * WIDTH else out[WIDTH] ^ carried
    return np.append(flat[:n], last[rows - 1 : rows])


def between(registers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The standard CRC-32 of the bytes from `starts` to `ends`, from the running registers alone."""
    lengths = ends - starts
    # the register at the start, and the initial complement of a fresh one, both carried over the part
    return registers[ends] ^ shifted(registers[starts] ^ _ONES, lengths) ^ _ONES
