"""Keyed BLAKE3 with extendable output, from the public specification."""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterable

import numpy as np

# Fixed values of the specification.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_START, _END, _PARENT, _ROOT, _KEYED = 1, 2, 4, 8, 16
_LANES = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
_MASK = 0xFFFFFFFF


def _compress(chain: tuple[int, ...], block: bytes, counter: int, flags: int) -> list[int]:
    """All 16 output words."""
    m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
    v = [*chain, *_IV[:4], counter & _MASK, counter >> 32, len(block), flags]
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_LANES):
            for word, r1, r2 in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = (v[a] + v[b] + word) & _MASK
                x = v[d] ^ v[a]
                v[d] = (x >> r1 | x << 32 - r1) & _MASK
                v[c] = (v[c] + v[d]) & _MASK
                x = v[b] ^ v[c]
                v[b] = (x >> r2 | x << 32 - r2) & _MASK
        m = [m[i] for i in _ORDER]
    return [x ^ y for x, y in zip(v[:8], v[8:])] + [x ^ y for x, y in zip(v[8:], chain)]


def _chunk(key: tuple[int, ...], data: bytes, index: int, flags: int) -> tuple[tuple[int, ...], bytes, int, int]:
    """The last compression of a chunk, not yet done: (chain, block, counter, flags)."""
    blocks = [data[i:i + 64] for i in range(0, len(data), 64)] or [b""]
    chain = key
    for i, block in enumerate(blocks[:-1]):
        chain = tuple(_compress(chain, block, index, flags | (_START if i == 0 else 0))[:8])
    return chain, blocks[-1], index, flags | (_START if len(blocks) == 1 else 0) | _END


def _node(key: tuple[int, ...], data: bytes, first: int, flags: int) -> tuple[tuple[int, ...], bytes, int, int]:
    chunks = -(-len(data) // 1024) or 1
    if chunks == 1:
        return _chunk(key, data, first, flags)
    left = 1 << (chunks - 1).bit_length() - 1
    parts = [_node(key, data[:left * 1024], first, flags), _node(key, data[left * 1024:], first + left, flags)]
    block = b"".join(struct.pack("<8I", *_compress(*p)[:8]) for p in parts)
    return key, block, 0, flags | _PARENT


def digest(data: bytes, size: int = 32, key: bytes | None = None) -> bytes:
    """The first ``size`` bytes of the (keyed) output."""
    if key is not None and len(key) != 32:
        raise ValueError("a key has 32 bytes")
    words, flags = (struct.unpack("<8I", key), _KEYED) if key is not None else (_IV, 0)
    chain, block, _, own = _node(words, data, 0, flags)
    return b"".join(struct.pack("<16I", *_compress(chain, block, i, own | _ROOT)) for i in range(-(-size // 64)))[:size]


def _compress_lanes(chain: np.ndarray, blocks: np.ndarray, counters: np.ndarray, sizes: np.ndarray, flags: int) -> np.ndarray:
    """_compress of N blocks at once: chain (8, N), blocks (16, N), all of 32 bits."""
    m, n = blocks, blocks.shape[1]
    v = [*(c.copy() for c in chain), *(np.full(n, x, np.uint32) for x in _IV[:4]), counters.astype(np.uint32), np.zeros(n, np.uint32), sizes.astype(np.uint32), np.full(n, flags, np.uint32)]
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_LANES):
            for word, r1, r2 in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] += v[b] + word
                x = v[d] ^ v[a]
                v[d] = x >> np.uint32(r1) | x << np.uint32(32 - r1)
                v[c] += v[d]
                x = v[b] ^ v[c]
                v[b] = x >> np.uint32(r2) | x << np.uint32(32 - r2)
        m = m[list(_ORDER)]
    return np.array([v[i] ^ v[i + 8] for i in range(8)] + [v[i + 8] ^ chain[i] for i in range(8)])


FEW = 16  # messages for which lanes cost more than they save


def digests(messages: Iterable[bytes], size: int = 32, key: bytes | None = None) -> dict[bytes, bytes]:
    """``digest`` of each distinct message; those of one chunk and as many blocks run side by side."""
    by_blocks: dict[int, list[bytes]] = defaultdict(list)
    for m in set(messages):
        by_blocks[max(1, -(-len(m) // 64)) if len(m) <= 1024 else 0].append(m)
    out = {}
    for blocks, some in by_blocks.items():
        if not blocks or len(some) < FEW:
            out |= {m: digest(m, size, key) for m in some}
            continue
        if key is not None and len(key) != 32:
            raise ValueError("a key has 32 bytes")
        words, own = (struct.unpack("<8I", key), _KEYED) if key is not None else (_IV, 0)
        data = np.frombuffer(b"".join(m.ljust(blocks * 64, b"\0") for m in some), "<u4").reshape(len(some), blocks, 16)
        last = np.array([len(m) - (blocks - 1) * 64 for m in some])
        chain = np.repeat(np.array(words, np.uint32)[:, None], len(some), 1)
        none, full = np.zeros(len(some)), np.full(len(some), 64)
        for i in range(blocks - 1):
            chain = _compress_lanes(chain, np.ascontiguousarray(data[:, i].T), none, full, own | (0 if i else _START))[:8]
        end, flags = np.ascontiguousarray(data[:, -1].T), own | _END | _ROOT | (_START if blocks == 1 else 0)
        parts = [np.ascontiguousarray(_compress_lanes(chain, end, np.full(len(some), i), last, flags).T).astype("<u4").tobytes() for i in range(-(-size // 64))]
        out |= {m: b"".join(p[64 * i:64 * i + 64] for p in parts)[:size] for i, m in enumerate(some)}
    return out
