"""Static range asymmetric numeral system over numpy arrays.

A block of symbols goes, symbol i to lane i modulo LANES, to LANES interleaved states of 64 bits that share one stream
of 32-bit words and one static frequency table. Symbols are pushed last to first, so they are popped in order. After
each CHECK symbols the states and the place in the stream are kept: a reader begins at any of these checkpoints, and
all segments between checkpoints are decoded side by side. Blocks are independent of each other.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

LANES = 32
#: Symbols of a block, and from one checkpoint to the next; multiples of each other and of LANES.
BLOCK, CHECK = 65_536, 16_384
#: Frequencies sum to 2 ** SCALE, more where there are more symbols than half of that.
SCALE, WIDEST = 20, 24
#: States lie from LOW up to LOW * 2 ** 32.
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<III")
WORD, HALF = np.uint64(32), np.uint64((1 << 32) - 1)


@dataclass
class Table:
    """Symbols with their frequencies, which sum to 2 ** scale."""

    ids: np.ndarray
    freq: np.ndarray
    scale: int

    def __post_init__(self):
        self.ids, self.freq = np.asarray(self.ids, dtype=np.uint32), np.asarray(self.freq, dtype=np.uint64)
        self.first = np.cumsum(self.freq, dtype=np.uint64) - self.freq
        self.both = self.freq << WORD | self.first  # one look-up for the two
        self.of_slot = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.freq.astype(np.int64))
        self.index = np.full(int(self.ids.max(initial=0)) + 1, -1, dtype=np.int32)
        self.index[self.ids] = np.arange(len(self.ids))

    @classmethod
    def of_counts(cls, counts: Sequence[tuple[int, int]]) -> Table:
        """From (id, how often): every id that occurs has a frequency of 1 at least."""
        counts = sorted((i, n) for i, n in counts if n > 0)
        scale = max(SCALE, len(counts).bit_length() + 1)
        if scale > WIDEST:
            raise ValueError(f"more than {1 << WIDEST - 1} symbols")
        total, free = sum(n for _, n in counts), (1 << scale) - len(counts)
        freq = [1 + n * free // total for _, n in counts]
        often = sorted(range(len(counts)), key=lambda k: (-counts[k][1], k))
        for k in often[: (1 << scale) - sum(freq)] if counts else ():  # what rounding has left, less than one each
            freq[k] += 1
        return cls([i for i, _ in counts], freq, scale)

    def to_bytes(self) -> bytes:
        body = HEAD.pack(len(self.ids), self.scale, 0) + self.ids.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        body, (crc,) = raw[:-4], struct.unpack("<I", raw[-4:])
        if zlib.crc32(body) != crc:
            raise ValueError("checksum of the frequency table")
        n, scale, _ = HEAD.unpack_from(body)
        return cls(np.frombuffer(body, "<u4", n, HEAD.size), np.frombuffer(body, "<u4", n, HEAD.size + 4 * n), scale)


def encode(table: Table, ids: np.ndarray) -> list[bytes]:
    """Blocks of the ids: all full ones side by side, then what is left."""
    ids = np.asarray(ids)
    full = len(ids) // BLOCK
    out = _encode(table, ids[: full * BLOCK].reshape(full, BLOCK), BLOCK) if full else []
    rest = ids[full * BLOCK :]
    if len(rest):
        padded = np.concatenate([rest, np.repeat(rest[-1:], -len(rest) % LANES)])
        out += _encode(table, padded.reshape(1, -1), len(rest))
    return out


def _encode(table: Table, rows: np.ndarray, tokens: int) -> list[bytes]:
    blocks, steps, every = len(rows), rows.shape[1] // LANES, CHECK // LANES
    symbols = table.index[rows]
    if (symbols < 0).any():
        raise ValueError("an id that the frequency table doesn't have")
    symbols = np.ascontiguousarray(symbols.reshape(blocks, steps, LANES).transpose(1, 0, 2))
    x = np.full((blocks, LANES), LOW, dtype=np.uint64)
    words, sent = np.empty(symbols.shape, dtype=np.uint32), np.empty(symbols.shape, dtype=bool)
    states = np.empty((-(-steps // every), blocks, LANES), dtype=np.uint64)
    shift, size = np.uint64(63 - table.scale), np.uint64(1 << table.scale)
    for t in range(steps - 1, -1, -1):
        both = table.both.take(symbols[t])
        f = both >> WORD
        words[t] = x  # the lower half
        np.greater_equal(x, f << shift, out=sent[t])
        x >>= sent[t] * WORD
        x += x // f * (size - f) + (both & HALF)
        if t % every == 0:
            states[t // every] = x
    out = []
    for b in range(blocks):
        at = np.concatenate([[0], np.cumsum(sent[:, b].sum(axis=1))])[:-1][::every]
        body = words[:, b][sent[:, b]]
        out.append(b"".join([
            HEAD.pack(tokens, len(body), len(at)), at.astype("<u4").tobytes(), states[:, b].astype("<u8").tobytes(), body.astype("<u4").tobytes(),
        ]))
    return out


@dataclass
class Block:
    """A block's checkpoints and words."""

    tokens: int
    at: np.ndarray
    states: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, raw: bytes) -> Block:
        tokens, words, checks = HEAD.unpack_from(raw)
        at = HEAD.size + 4 * checks
        return cls(
            tokens, np.frombuffer(raw, "<u4", checks, HEAD.size).astype(np.int64), np.frombuffer(raw, "<u8", checks * LANES, at).reshape(checks, LANES),
            np.frombuffer(raw, "<u4", words, at + 8 * checks * LANES),
        )

    def segment(self, i: int) -> int:
        """Symbols of segment i."""
        return min(CHECK, self.tokens - i * CHECK)


def decode(table: Table, segments: Sequence[tuple[Block, int]]) -> list[np.ndarray]:
    """Ids of each (block, number of the segment); segments of equal length are decoded side by side."""
    out: list = [None] * len(segments)
    lengths = [b.segment(i) for b, i in segments]
    for n in set(lengths):
        which = [k for k, m in enumerate(lengths) if m == n]
        for k, ids in zip(which, _decode(table, [segments[k] for k in which], n)):
            out[k] = ids
    return out


def _decode(table: Table, segments: Sequence[tuple[Block, int]], tokens: int) -> np.ndarray:
    blocks = {id(b): b for b, _ in segments}
    begin, words = {}, 0
    for key, b in blocks.items():
        begin[key], words = words, words + len(b.words)
    stream = np.concatenate([b.words for b in blocks.values()])
    x = np.stack([b.states[i] for b, i in segments]).astype(np.uint64)
    at = np.array([begin[id(b)] + b.at[i] for b, i in segments], dtype=np.int64)
    ends = np.array([begin[id(b)] + (b.at[i + 1] if i + 1 < len(b.at) else len(b.words)) for b, i in segments])
    steps = -(-tokens // LANES)
    found = np.empty((steps, len(segments), LANES), dtype=np.int32)
    low, scale = np.uint64((1 << table.scale) - 1), np.uint64(table.scale)
    for t in range(steps):
        slot = x & low
        symbol = table.of_slot.take(slot.view(np.int64), out=found[t], mode="clip")
        both = table.both.take(symbol)
        x >>= scale
        x *= both >> WORD
        x += slot - (both & HALF)
        short = x < LOW
        rank = short.cumsum(axis=1)
        rank += (at - 1)[:, None]
        place = np.flatnonzero(short)
        flat = x.reshape(-1)
        flat[place] = flat.take(place) << WORD | stream.take(rank.reshape(-1).take(place))
        at = rank[:, -1] + 1
    if not np.array_equal(at, ends):
        raise ValueError("a segment doesn't end at its checkpoint")
    return table.ids[found.transpose(1, 0, 2).reshape(len(segments), -1)[:, :tokens]]
