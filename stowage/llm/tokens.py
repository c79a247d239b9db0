"""Token ids of whole texts through the tokenizers library, one call for each distinct piece.

Texts are cut only where the tokenizer's own splitting always cuts, so the pieces' ids joined are the text's ids:
before a space that a visible character follows and around a single line end (``byte``), or at white space (``word``),
and between a letter or digit and a mark other than an apostrophe (of ASCII, in both). Cutting, hashing and looking up
are vector operations over the bytes of many texts. Pieces are known by two 64-bit hashes, so two different ones are
mistaken for each other with a probability of about n**2 / 2**129; longer ones than LONGEST bytes always go to the
library. The table of pieces is of bounded size, as most pieces of a corpus recur; when it is full, the most frequent
ones stay.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces, and ids of pieces, that a worker keeps (about 40 and 4 bytes each), and parts of words (strings of some 200 bytes).
KEPT_PIECES, KEPT_IDS, KEPT_PARTS = 400_000, 4_000_000, 100_000
#: Bytes of a piece that is hashed at most, and of texts that are hashed at a time.
LONGEST, BLOCK = 256, 1 << 19
#: Pieces that are joined to one text for a call of the library.
JOINED = 1000
#: Odd bases of the two hashes, and the seed of their tables of byte values (fixed values).
BASES, SEED = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), 7
_PLAIN = re.compile(r" ?[\x21-\x7e\xa1-ɏ]*\Z")
_CLEAN = re.compile(r" ?[^\s]+\Z")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Store:
    """Ids of numbered pieces in flat arrays."""

    def __init__(self) -> None:
        self.count = 0
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def put(self, numbers: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        while self.count > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.sizes[numbers] = sizes
        self.starts[numbers] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered pieces one after the other, and where each ends."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        if not len(ends):
            return np.empty(0, np.uint32), ends
        return self.flat[np.repeat(self.starts[numbers] - ends + sizes, sizes) + np.arange(ends[-1])], ends


class _Numbers(dict):
    """String to number; asking for a new one gives it the next number of the store and notes it."""

    def __init__(self, store: Store) -> None:
        self.store, self.fresh = store, []

    def __missing__(self, part: str) -> int:
        self[part] = n = self.store.count
        self.store.count += 1
        self.fresh.append(part)
        return n


class Table:
    """Numbers of pieces by their two hashes, with open addressing."""

    def __init__(self) -> None:
        self.slots = np.full(1 << 15, -1, np.int32)
        self.keys = np.zeros((2, 1 << 14), np.uint64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece, or -1."""
        out = np.full(hashes.shape[1], -1, np.int32)
        left, mask = np.arange(hashes.shape[1]), len(self.slots) - 1
        at = (hashes[0] & np.uint64(mask)).astype(np.int64)
        while len(left):
            number = self.slots[at]
            met = number >= 0
            left, at, number = left[met], at[met], number[met]
            same = (self.keys[0][number] == hashes[0][left]) & (self.keys[1][number] == hashes[1][left])
            out[left[same]] = number[same]
            left, at = left[~same], at[~same] + 1 & mask
        return out

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """New pieces, each once. Numbers go on from those there are."""
        if not len(numbers):
            return
        total = int(numbers[-1]) + 1
        while total > self.keys.shape[1]:
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)], axis=1)
        self.keys[:, numbers] = hashes
        if 2 * total > len(self.slots):
            while 2 * total > len(self.slots):
                self.slots = np.full(2 * len(self.slots), -1, np.int32)
            numbers = np.flatnonzero(self.keys.any(axis=0)[:total]).astype(np.int32)
        self._place(numbers)

    def _place(self, numbers: np.ndarray) -> None:
        mask = len(self.slots) - 1
        at = (self.keys[0][numbers] & np.uint64(mask)).astype(np.int64)
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            left = self.slots[at] != numbers  # taken before, or by another one just now
            numbers, at = numbers[left], at[left] + 1 & mask


def _byte_values() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK + LONGEST, base, np.uint64)]))


VISIBLE = np.array([0x20 < b < 0x80 and b != 0x7F or b >= 0x80 and b not in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])  # surely no white space begins with it
#: 1 for a letter or digit, 2 for a mark other than an apostrophe (of ASCII).
CLASS = np.array([1 if chr(b).isalnum() and b < 0x80 else 2 if 0x20 < b < 0x7F and b != 0x27 else 0 for b in range(256)], np.int8)
WHITE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


class PieceEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words = self.tokenizer.normalizer is not None  # white space goes, so a text may be cut at all of it
        if self.words:
            import regex

            self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+| ").findall
            self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        else:
            self.newline = self.library(["\n"])[0][0]
        self.prepare()

    def prepare(self) -> None:
        self.values, self.powers = _byte_values(), [_powers(b) for b in BASES]
        self.reset()

    def reset(self) -> None:
        self.store, self.table, self.uses = Store(), Table(), np.zeros(0, np.int64)
        self.parts = Store()
        self.part = _Numbers(self.parts)

    def library(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of pieces that the tokenizer never joins to each other, many in one call."""
        texts = [pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)]
        all_ids, all_sizes = [], []
        for group, ids in zip(texts, self.library([(" " if self.words else "\n").join(t) for t in texts]), strict=True):
            if self.words:  # the last id of each piece says so
                ends = np.flatnonzero(self.closes[ids]) + 1
                sizes = np.diff(ends, prepend=0)
            else:
                between = ids == self.newline
                sizes = np.diff(np.flatnonzero(between), prepend=-1, append=len(ids)) - 1
                ids = ids[~between]
            if len(sizes) != len(group) or sizes.sum() != len(ids):
                ids, sizes = self.singly(group)
            all_ids.append(ids)
            all_sizes.append(sizes)
        return np.concatenate([*all_ids, np.empty(0, np.uint32)]), np.concatenate([*all_sizes, np.empty(0, np.int64)]).astype(np.int64)

    def singly(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = self.library(pieces)
        return np.concatenate([*own, np.empty(0, np.uint32)]), np.array([len(x) for x in own], np.int64)

    def by_parts(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of plain words. The parts of a word are encoded each for itself, so they are kept too: there are fewer of them than words."""
        flat = self.split(self.tokenizer.normalizer.normalize_str(" ".join(pieces)))
        between = np.fromiter((p == " " for p in flat), bool, len(flat))
        if len(self.part) > KEPT_PARTS:
            self.parts = Store()
            self.part = _Numbers(self.parts)
        numbers = np.fromiter(map(self.part.__getitem__, (p for p in flat if p != " ")), np.int64, len(flat) - int(between.sum()))
        if self.part.fresh:
            ids, sizes = self.joined(self.part.fresh)
            self.parts.put(np.arange(self.parts.count - len(sizes), self.parts.count), sizes, ids)
            self.part.fresh = []
        ids, ends = self.parts.get(numbers)
        upto = np.concatenate([[0], ends])[np.append(np.flatnonzero(between) - np.arange(between.sum()), len(numbers))]
        return ids, np.diff(upto, prepend=0)

    def ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of any pieces, in their order. White space within one is rare, and so are characters that the library may class in another way."""
        usual, encode = (_PLAIN.match, self.by_parts) if self.words else (_CLEAN.match, self.joined)
        easy = np.fromiter((usual(p) is not None for p in pieces), bool, len(pieces))
        if easy.all():
            return encode(pieces)
        found = [encode([p for p, e in zip(pieces, easy, strict=True) if e]) if easy.any() else self.singly([]), self.singly([p for p, e in zip(pieces, easy, strict=True) if not e])]
        own = Store()
        own.count = len(pieces)
        for way, (ids, sizes) in zip((easy, ~easy), found, strict=True):
            own.put(np.flatnonzero(way), sizes, ids)
        return own.get(np.arange(len(pieces)))[0], own.sizes[: len(pieces)]

    def cut(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of texts begin and end; ``begins`` and ``ends`` are of the texts that aren't empty."""
        kind = CLASS[raw]
        between = np.flatnonzero(kind[1:] + kind[:-1] == 3) + 1
        if self.words:
            solid = ~WHITE[raw]
            first, last = solid.copy(), solid.copy()
            first[1:] &= ~solid[:-1]
            last[:-1] &= ~solid[1:]
            first[begins] = solid[begins]
            last[ends - 1] = solid[ends - 1]
            first[between] = last[between - 1] = True
            return np.flatnonzero(first), np.flatnonzero(last) + 1
        visible = VISIBLE[raw]
        cut = raw == 32
        cut[:-1] &= visible[1:]
        line = np.flatnonzero((raw[1:-1] == 10) & (kind[:-2] > 0) & visible[2:]) + 1
        cut[line] = cut[line + 1] = True
        cut[between] = True
        cut[ends - 1] &= kind[ends - 1] > 0  # not before white space that ends a text
        cut[begins] = True
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], len(raw))

    def hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Two hashes of each piece, polynomials of its bytes. ``raw`` has BLOCK + LONGEST bytes at most."""
        out = np.empty((2, len(starts)), np.uint64)
        for i in range(2):
            upto = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(self.values[i][raw] * self.powers[i][: len(raw)], out=upto[1:])
            own = (upto[ends] - upto[starts]) * self.powers[i][len(self.powers[i]) - 1 - starts]  # as if all began at one place
            own += (ends - starts).astype(np.uint64)
            out[i] = own ^ (own >> np.uint64(29))
        return out

    def numbers_of(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The pieces' numbers in the store, into which new ones are put."""
        numbers = np.empty(len(starts), np.int64)
        at = 0
        while at < len(starts):
            upto = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, side="right")))
            s, e = starts[at:upto], ends[at:upto]
            short = np.flatnonzero(e - s <= LONGEST)
            long = np.flatnonzero(e - s > LONGEST)
            own = np.full(upto - at, -1, np.int64)
            if len(short):
                base = s[short[0]]
                h = self.hashes(raw[base : e[short[-1]]], s[short] - base, e[short] - base)
                found = self.table.find(h).astype(np.int64)
                new = np.flatnonzero(found < 0)
                if len(new):
                    _, first, which = np.unique(h[0][new], return_index=True, return_inverse=True)
                    same = (h[1][new] == h[1][new][first][which]).all()
                    if not same:  # equal first hashes of different pieces
                        _, first, which = np.unique(h[:, new], axis=1, return_index=True, return_inverse=True)
                    fresh = self.put([raw[x:y].tobytes().decode() for x, y in zip(s[short[new[first]]].tolist(), e[short[new[first]]].tolist(), strict=True)])
                    self.table.add(h[:, new[first]], fresh.astype(np.int32))
                    found[new] = fresh[which.reshape(-1)]
                own[short] = found
            if len(long):
                own[long] = self.put([raw[x:y].tobytes().decode() for x, y in zip(s[long].tolist(), e[long].tolist(), strict=True)])
            numbers[at:upto] = own
            at = upto
        return numbers

    def put(self, pieces: list[str]) -> np.ndarray:
        ids, sizes = self.ids_of(pieces)
        numbers = np.arange(self.store.count, self.store.count + len(pieces))
        self.store.count += len(pieces)
        self.store.put(numbers, sizes, ids)
        return numbers

    def shrink(self) -> None:
        """Keep the pieces used most, up to two thirds of the room, and those only that were used more than once."""
        old, table, uses = self.store, self.table, self.uses
        known = table.keys.any(axis=0)[: old.count]
        order = np.argsort(-uses[: old.count], kind="stable")
        order = order[(uses[order] > 1) & known[order]][: KEPT_PIECES * 2 // 3]
        kept = order[np.cumsum(old.sizes[order]) <= KEPT_IDS * 2 // 3]
        self.store, self.table = Store(), Table()
        self.store.count = len(kept)
        ids = old.get(kept)[0]
        self.store.put(np.arange(len(kept)), old.sizes[kept], ids)
        self.table.add(table.keys[:, kept], np.arange(len(kept), dtype=np.int32))
        self.uses = uses[kept] // 2

    def encode(self, texts: pa.Array | Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin (with the end as a last entry); null is empty."""
        if self.store.count > KEPT_PIECES or self.store.used > KEPT_IDS:
            self.shrink()
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        if not len(column) or offsets[-1] == offsets[0]:
            return np.empty(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        filled = np.flatnonzero(np.diff(offsets))
        starts, ends = self.cut(raw, offsets[filled], offsets[filled + 1])
        numbers = self.numbers_of(raw, starts, ends)
        used = np.bincount(numbers, minlength=self.store.count)
        used[: len(self.uses)] += self.uses
        self.uses = used
        ids, upto = self.store.get(numbers)
        return ids, np.concatenate([[0], upto])[np.searchsorted(starts, offsets)]


_loaded: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file, made once."""
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


def slices(lengths: Sequence[int], limit: int) -> list[tuple[int, int]]:
    """Consecutive ranges of rows whose lengths sum to about ``limit`` at most; a longer row is a range of its own."""
    out, at, total = [], 0, 0
    for i, n in enumerate(lengths):
        if i > at and total + n > limit:
            out.append((at, i))
            at, total = i, 0
        total += n
    if at < len(lengths):
        out.append((at, len(lengths)))
    return out


def text_sizes(batch: pa.RecordBatch, column: str = "text") -> list[int]:
    """Bytes of each text of a batch; null has none."""
    return pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()
