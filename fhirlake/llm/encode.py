"""Byte-level BPE encoding by pieces: shared by token counts and packing.

The vocabulary's pre-tokenizer never lets a token reach from a character that is not
white space into a blank after it. A text may therefore be cut before such blanks, and its pieces
(words with what stands around them) may be encoded one by one. Pieces repeat a lot, so a batch
finds its distinct pieces by 64-bit hashes of their bytes and encodes each of them once.

Pieces of plain characters, where the two libraries' patterns cannot differ, go to the faster one in a
single call with the same vocabulary (token ids are merge ranks, which is checked). All other
pieces go to the tokenizer itself. A text in which a blank follows other white space is encoded whole by it,
as is every text of a vocabulary of another kind. A special string of the vocabulary starts with "<",
which is not a plain character, and holds no white space, so that no cut falls inside one; the tokenizer
treats it as it does by default.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import tiktoken

from fhirlake.llm.spans import RangeHash, process_cache, text_bytes

# Longer pieces are encoded each time they come, so that the dictionary's size is bounded. It outlives the task.
LONGEST_KEPT = 64
MOST_KEPT = 100_000
BATCH_BYTES = 1 << 20
# Fixed value: the pre-tokenizer's published pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK, BREAK = 32, 10
# Last bytes of ASCII characters that some library calls white space.
NARROW = np.zeros(256, bool)
NARROW[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
# Bytes of pieces that either library reads alike: visible ASCII but "<", Latin letters of two bytes, and
# (see odd_bytes) single line breaks inside.
ODD = np.ones(256, bool)
ODD[32:127] = False
ODD[ord("<")] = True
LEAD = 0xC3


def load(path: str):
    """The tokenizer of a .json file, read once per worker."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    cache = process_cache()
    if path not in cache:
        cache[path] = Tokenizer.from_file(path)
    return cache[path]


def can_cut(tokenizer) -> bool:
    """Whether cutting before blanks keeps the library's result, for this vocabulary."""
    spec = json.loads(tokenizer.to_str())
    pre = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    return (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and spec["model"].get("type") == "BPE"
        and all(t["content"].startswith("<") and not re.search(r"\s", t["content"]) for t in added)
        and not any(t["lstrip"] or t["rstrip"] for t in added)
    )


def ranks(tokenizer) -> dict[bytes, int] | None:
    """The vocabulary's byte strings by id, if ids are merge ranks as the faster library needs."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    letters = {chr(256 + n): b for n, b in enumerate(others)} | {chr(b): b for b in printable}
    spec = json.loads(tokenizer.to_str())["model"]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["merges"]]
    if [spec["vocab"].get(m) for m in merged] != list(range(256, 256 + len(merged))):
        return None
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    return {bytes(letters[c] for c in token): n for token, n in spec["vocab"].items() if token not in special}


def odd_bytes(raw: np.ndarray) -> np.ndarray:
    odd = ODD[raw]
    lead = np.flatnonzero(raw[:-1] == LEAD)
    second = raw[lead + 1]
    fine = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
    odd[fine] = False
    odd[fine + 1] = False
    breaks = np.flatnonzero(raw == BREAK)
    before, after = raw[np.maximum(breaks - 1, 0)], raw[np.minimum(breaks + 1, len(raw) - 1)]
    odd[breaks] = (before == BLANK) | (before == BREAK) | (after == BREAK) | (breaks == 0) | (breaks == len(raw) - 1)
    return odd


def after_white_space(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each position is white space in any sense; `at` is 3 or more."""
    one, two, three = raw[at - 1], raw[at - 2], raw[at - 3]
    wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    wide |= (three == 0xE1) & (two == 0x9A) & (one == 0x80)
    wide |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    wide |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
    wide |= (three == 0xE3) & (two == 0x80) & (one == 0x80)
    return NARROW[one] | wide


class Encoder:
    """Ids of whole texts; `batch` gives them for one Arrow column in a flat form."""

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        cache = process_cache()
        if (path, "cut") not in cache:
            cache[path, "cut"] = can_cut(self.tokenizer)
            cache[path, "fast"] = None
            known = ranks(self.tokenizer) if cache[path, "cut"] else None
            if known is not None:
                cache[path, "fast"] = tiktoken.Encoding(
                    "plain", pat_str=PATTERN, mergeable_ranks=known, special_tokens={}
                )
        self.cut, self.fast = cache[path, "cut"], cache[path, "fast"]
        self.kept: dict[bytes, bytes] = cache.setdefault((path, "kept"), {})

    def _library(self, texts: list[str]) -> list[list[int]]:
        """By the tokenizer, in calls of bounded size: an encoding takes far more room than its text."""
        found: list[list[int]] = []
        part: list[str] = []
        size = 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size > BATCH_BYTES:
                found += [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                part, size = [], 0
        return found + [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def _plain(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids per piece and all ids. Tabs, which no plain piece holds, keep the pieces apart."""
        if not pieces:
            return np.empty(0, np.int64), np.empty(0, np.uint32)
        ids = np.asarray(self.fast.encode_ordinary(b"\t".join(pieces).decode() + "\t"), np.uint32)
        (tab,) = self.fast.encode_ordinary("\t")
        ends = np.flatnonzero(ids == tab)
        return np.diff(ends, prepend=-1) - 1, ids[ids != tab]

    def _others(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        missing = [p for p in pieces if p not in self.kept]
        found = self._library([p.decode() for p in missing])
        fresh = {p: np.asarray(i, np.uint32).tobytes() for p, i in zip(missing, found)}  # lists take several times the room
        ids = [fresh[p] if p in fresh else self.kept[p] for p in pieces]
        if len(self.kept) > MOST_KEPT:
            self.kept.clear()
        self.kept.update((p, i) for p, i in fresh.items() if len(p) <= LONGEST_KEPT)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return lengths, np.frombuffer(b"".join(ids), np.uint32)

    def batch(self, column: pa.Array, with_ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Ids per text of a string column without nulls, and all ids one after the other."""
        raw, starts = text_bytes(column)
        counts = np.zeros(len(column), np.int64)
        parts: list[np.ndarray] = []
        for text, lo, hi in self._ranges(raw, starts):
            per_text, ids = self._range(raw[lo:hi], text - lo, with_ids)
            first = int(np.searchsorted(starts, lo, "right")) - 1
            counts[first : first + len(per_text)] += per_text
            if ids is not None:
                parts.append(ids)
        return counts, (np.concatenate(parts) if parts else np.empty(0, np.uint32)) if with_ids else None

    def _ranges(self, raw: np.ndarray, starts: np.ndarray):
        """(text starts, from, to): ranges of bounded size; only a text longer than that is cut, where it may be."""
        lo, end = int(starts[0]), int(starts[-1])
        while lo < end:
            hi = min(lo + BATCH_BYTES, end)
            if hi < end:
                text = int(starts[np.searchsorted(starts, hi, "right") - 1])  # begins at or before hi
                hi = text if text > lo else self._next_cut(raw, hi, int(starts[np.searchsorted(starts, hi, "right")]))
            inner = starts[np.searchsorted(starts, lo, "right") : np.searchsorted(starts, hi, "left")]
            yield np.concatenate([[lo], inner]), lo, hi
            lo = hi

    def _next_cut(self, raw: np.ndarray, at: int, end: int) -> int:
        """The first blank from `at` on after a visible ASCII character; the text's end if there is none."""
        if not self.cut:
            return end
        for lo in range(at, end, BATCH_BYTES):
            view = raw[lo - 1 : min(lo + BATCH_BYTES, end)]
            found = np.flatnonzero((view[1:] == BLANK) & (view[:-1] > 32) & (view[:-1] < 127))
            if len(found):
                return lo + int(found[0])
        return end

    def _range(self, raw: np.ndarray, texts: np.ndarray, with_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Ids per text that begins in `raw` (at `texts`, some of them empty)."""
        blank = raw == BLANK
        blank[texts] = True
        pieces = np.flatnonzero(blank)
        owner = np.searchsorted(texts, pieces, "right") - 1
        inner = ~np.isin(pieces, texts)
        whole = np.zeros(len(texts), bool)
        if self.cut:
            checked = pieces[inner & (pieces >= 3)]
            whole[owner[inner & (pieces >= 3)][after_white_space(raw, checked)]] = True
            early = inner & (pieces < 3)  # too near the start to look back three bytes
            whole[owner[early]] = True
        else:
            whole[:] = True
        keep = ~(inner & whole[owner])
        pieces, owner = pieces[keep], owner[keep]
        ends = np.append(pieces[1:], len(raw))
        hashes = RangeHash(raw)(pieces, ends)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        # Distinct pieces, those for the faster library first.
        odd = np.append(0, np.cumsum(odd_bytes(raw)))
        is_odd = (odd[ends[first]] != odd[pieces[first]]) | (self.fast is None)
        final = raw[ends[first] - 1]
        is_odd |= (final == BLANK) | (final == BREAK)  # would join the tab after it
        order = np.argsort(is_odd, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        inverse = place[inverse]
        first = first[order]
        data = raw.tobytes()
        distinct = [data[a:b] for a, b in zip(pieces[first].tolist(), ends[first].tolist())]
        n_plain = len(order) - int(is_odd.sum())
        plain_lengths, plain_ids = self._plain(distinct[:n_plain])
        other_lengths, other_ids = self._others(distinct[n_plain:])
        lengths = np.concatenate([plain_lengths, other_lengths])
        sizes = lengths[inverse]
        per_text = np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)
        if not with_ids:
            return per_text, None
        flat = np.concatenate([plain_ids, other_ids])
        begin = (np.cumsum(lengths) - lengths)[inverse]
        before = np.cumsum(sizes) - sizes
        where = np.arange(int(sizes.sum())) + np.repeat(begin - before, sizes)
        return per_text, flat[where]
