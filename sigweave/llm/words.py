"""Words of texts as 64-bit hashes, for a whole Arrow batch at a time.

A word is `[^\\x20\\x09-\\x0D]+`. Words take in eight bytes a step, all at once, and mix
all bits after each; the few very long ones are hashed apart by BLAKE2b. So a word's
hash doesn't hang on sums over its letters, which words of a regular make-up may share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes hashed at a time; longer texts are cut at white space.
CHUNK = 1 << 19
#: What a step multiplies with and adds: odd, without a pattern.
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one.
LONG = 256


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of `data`, and their starts; a word ends at white space and at each border."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = borders[(borders > 0) & (borders < len(data))]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sizes = ends - starts
    # the eight bytes from any place on, as a number
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = mixed(sizes.astype(np.uint64) * STEP)
    now = np.flatnonzero(sizes <= LONG)
    at = 0
    while len(now):
        left = sizes[now] - at
        block = eight[starts[now] + at]
        short = left < 8
        block[short] &= (np.uint64(1) << (np.uint64(8) * left[short].astype(np.uint64))) - np.uint64(1)
        h[now] = mixed((h[now] ^ block) * STEP + STEP)
        at += 8
        now = now[left > 8]
    for i in np.flatnonzero(sizes > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h, starts


def hashed_words(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, hashes, offsets): the words of row `first + i` are hashes[offsets[i]:offsets[i + 1]]. A null text has none."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        # as many whole texts as a chunk holds, one at least
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        part = data[offsets[row] : offsets[to]]
        part = LOWER[part] if lower else part
        borders = offsets[row : to + 1] - offsets[row]
        if len(part) <= CHUNK:
            h, starts = _hashes(part, borders) if len(part) else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield row, h, np.searchsorted(starts, borders)
        else:
            found, at = [], 0
            while at < len(part):
                end = min(at + CHUNK, len(part))
                while end < len(part) and not (gaps := np.flatnonzero(SPACE[part[at:end]])).size:
                    end = min(end + CHUNK, len(part))
                end = at + int(gaps[-1]) + 1 if end < len(part) else end
                found.append(_hashes(part[at:end], np.empty(0, np.int64))[0])
                at = end
            yield row, np.concatenate(found), np.array([0, sum(map(len, found))])
        row = to


#: Odd multipliers, one for each place in a window of words.
PLACES = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of `width` words; of fewer words the whole sequence is the one window, of none there is none."""
    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out += h[k : k + n] * PLACES[k]
    return mixed(out)
