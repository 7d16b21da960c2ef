"""Static range asymmetric numeral system over token ids: interleaved lanes, checkpoints, checksums.

A section is a run of ids with one frequency table. Its blocks are coded independently; inside a block the ids are
dealt to lanes in turn, and every lane has a 64-bit state that gives off 32-bit words. A checkpoint keeps the lanes'
states and the place in the words, so that decoding can start there; each span between checkpoints has a checksum.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BITS = 18  # frequencies of a table sum to 2^18
LOW = np.uint64(1 << 31)  # a state stays in [2^31, 2^63)
LANES = 256
BLOCK_IDS = 1 << 18
STEPS_PER_CHECKPOINT = 256
HEAD = struct.Struct("<4sHHIII")  # magic, lanes, steps per checkpoint, steps, ids, checkpoints
MAGIC = b"rTK1"


def frequencies(ids: np.ndarray) -> np.ndarray:
    """Frequency of each id up to the largest, scaled to 2^18, at least 1 for an id that occurs."""
    counts = np.bincount(ids).astype(np.int64)
    present = np.count_nonzero(counts)
    if present > 1 << BITS:
        raise ValueError(f"more than {1 << BITS} distinct ids in a section")
    scaled = np.where(counts > 0, 1 + counts * ((1 << BITS) - present) // max(1, counts.sum()), 0)
    scaled[counts.argmax()] += (1 << BITS) - scaled.sum()
    return scaled


def pack_table(freq: np.ndarray) -> bytes:
    return zlib.compress(freq.astype("<u4").tobytes(), 6)


def unpack_table(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)


def encode(ids: np.ndarray, freq: np.ndarray, block_ids: int = BLOCK_IDS, lanes: int = LANES) -> list[bytes]:
    """The section's blocks; all blocks run side by side, each with its own words and states."""
    n = len(ids)
    blocks = max(1, -(-n // block_ids))
    steps = max(1, -(-n // (blocks * lanes)))
    padded = np.full(blocks * steps * lanes, int(freq.argmax()), np.int64)
    padded[:n] = ids
    grid = padded.reshape(blocks, steps, lanes)
    first = (np.cumsum(freq) - freq).astype(np.uint64)
    freq = freq.astype(np.uint64)
    state = np.full((blocks, lanes), LOW)
    words, owner, step_of, saved = [], [], [], {}
    for t in range(steps - 1, -1, -1):
        symbol = grid[:, t]
        f = freq[symbol]
        full = state >= (f << np.uint64(63 - BITS))
        block, _ = np.nonzero(full)
        words.append((state[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        owner.append(block)
        step_of.append(np.full(len(block), t))
        state = np.where(full, state >> np.uint64(32), state)
        quotient = state // f
        state = (quotient << np.uint64(BITS)) + (state - quotient * f) + first[symbol]
        if t % STEPS_PER_CHECKPOINT == 0:
            saved[t] = state.copy()
    words, owner, step_of = (np.concatenate(x[::-1]) for x in (words, owner, step_of))
    out = []
    for b in range(blocks):
        mine = owner == b
        stream, at = words[mine], step_of[mine]
        starts = np.searchsorted(at, sorted(saved))
        spans = [stream[i:j] for i, j in zip(starts, [*starts[1:], len(stream)])]
        held = min(n, (b + 1) * steps * lanes) - min(n, b * steps * lanes)
        parts = [HEAD.pack(MAGIC, lanes, STEPS_PER_CHECKPOINT, steps, held, len(saved))]
        for t, i, span in zip(sorted(saved), starts, spans):
            body = saved[t][b].astype("<u8").tobytes()
            parts.append(struct.pack("<II", i, zlib.crc32(span.tobytes(), zlib.crc32(body))) + body)
        out.append(b"".join([*parts, stream.tobytes()]))
    return out


def spans_of(block: bytes) -> tuple[int, int, int, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Lanes, ids and checkpoints of a block: (steps, states, words) of each span, checksums verified."""
    magic, lanes, every, steps, n, checkpoints = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    size = 8 + 8 * lanes
    entries = [HEAD.size + k * size for k in range(checkpoints)]
    words = np.frombuffer(block, "<u4", offset=HEAD.size + checkpoints * size)
    marks = [struct.unpack_from("<II", block, e) for e in entries]
    out = []
    for k, (e, (start, crc)) in enumerate(zip(entries, marks)):
        body = block[e + 8 : e + size]
        span = words[start : marks[k + 1][0] if k + 1 < checkpoints else len(words)]
        if zlib.crc32(span.tobytes(), zlib.crc32(body)) != crc:
            raise ValueError(f"checksum of checkpoint {k} does not match")
        out.append((min(every, steps - k * every), np.frombuffer(body, "<u8"), span))
    return lanes, n, steps, out


def unwind(spans: list[tuple[int, np.ndarray, np.ndarray]], freq: np.ndarray) -> list[np.ndarray]:
    """Ids of independent spans, decoded side by side."""
    symbol_at = np.repeat(np.arange(len(freq), dtype=np.int64), freq)
    first = (np.cumsum(freq) - freq).astype(np.uint64)
    freq = freq.astype(np.uint64)
    state = np.stack([s for _, s, _ in spans]).astype(np.uint64)
    words = np.concatenate([w for *_, w in spans] + [np.zeros(1, "<u4")]).astype(np.uint64)
    ends = np.cumsum([len(w) for *_, w in spans])
    place = ends - [len(w) for *_, w in spans]
    length = np.array([n for n, *_ in spans])
    out = np.zeros((len(spans), length.max(), state.shape[1]), np.int32)
    for t in range(length.max()):
        slot = state & np.uint64((1 << BITS) - 1)
        symbol = symbol_at[slot]
        out[:, t] = symbol
        state = freq[symbol] * (state >> np.uint64(BITS)) + slot - first[symbol]
        low = (state < LOW) & (t < length)[:, None]
        taken = np.cumsum(low, axis=1)
        read = words[np.minimum(place[:, None] + taken - 1, len(words) - 1)]
        state = np.where(low, state << np.uint64(32) | read, state)
        place = place + taken[:, -1]
    return [out[i, :n].ravel() for i, n in enumerate(length)]


def decode(blocks: list[bytes], freq: np.ndarray) -> np.ndarray:
    """Ids of a section from all its blocks."""
    parsed = [spans_of(b) for b in blocks]
    ids = unwind([s for *_, spans in parsed for s in spans], freq)
    out, at = [], 0
    for _, n, _, spans in parsed:
        out.append(np.concatenate(ids[at : at + len(spans)])[:n])
        at += len(spans)
    return np.concatenate(out)
