"""Vectorised word scanning over UTF-8 bytes.

The similarity and containment operators all read whole texts as sequences of
words.  Words are hashed in bulk with numpy: one table tells which bytes belong
to words, another lower-cases A-Z, and the words' bytes are gathered eight at a
time and mixed in turn, so that words of up to eight bytes and equal length
never share a hash.  Words of more than LONG_WORD bytes take a BLAKE2b digest
instead.  A text is worked off in chunks that end between words, so memory
follows the chunk, not the text.  Hashes depend on the word alone: every
process gets the same values.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes worked off at a time; a longer word makes a longer chunk.
CHUNK = 1 << 20
#: Bytes of short texts worked off together; the arrays stay in a core's cache.
RUN = 1 << 17
#: Bytes of a word up to which it is hashed in lanes of eight.
LONG_WORD = 32

_ROOT = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Which bytes belong to words (1 or 0), and their lower case, for bytes.translate.
Tables = tuple[bytes, bytes]


def space_separated() -> Tables:
    """Tables for words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased."""
    return bytes(b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)), _LOWER


def letters_and_digits() -> Tables:
    """Tables for words of 0-9, a-z and all code points from U+0080 on."""
    return bytes(b >= 0x80 or chr(b).isalnum() for b in range(256)), _LOWER


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_chunk(data: bytes, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in ``data``, and their hashes."""
    inside = np.frombuffer(b"\0" + data.translate(tables[0]) + b"\0", dtype=np.uint8)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64)
    lengths = ends - starts
    low = data.translate(tables[1]) + bytes(8)
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=low, strides=(1,))
    out = mix((eight[starts] & _MASK[np.minimum(lengths, 8)]) ^ (lengths.astype(np.uint64) * _ROOT))
    for at in range(8, LONG_WORD, 8):
        more = np.flatnonzero(lengths > at)
        if not len(more):
            break
        out[more] = mix(out[more] * _ROOT + (eight[starts[more] + at] & _MASK[np.minimum(lengths[more] - at, 8)]))
    for i in np.flatnonzero(lengths > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]], digest_size=8).digest())
    return starts, out


def _long(text: bytes, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """``_hash_chunk`` of a text of any length, a chunk at a time."""
    inside = np.frombuffer(text.translate(tables[0]), dtype=np.uint8)
    starts, hashes, at = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)], 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        # back to the last gap, or on to the next one if a word fills the chunk
        while end < len(text):
            gaps = np.flatnonzero(inside[max(at, end - 65536) : end] == 0)
            if len(gaps):
                end = max(at, end - 65536) + int(gaps[-1]) + 1
                break
            end = min(end + 65536, len(text))
        some, found = _hash_chunk(text[at:end], tables)
        starts.append(some + at)
        hashes.append(found)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def word_hashes(text: bytes, tables: Tables) -> np.ndarray:
    """One uint64 for each word of the text, in order."""
    return _long(text, tables)[1]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One uint64 for each run of ``size`` words; fewer words make one run."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, np.uint64(size))
    for k in range(size):
        out = mix(out * _ROOT + words[k : len(words) - size + 1 + k])
    return out


def slices(batches, rows: int = 500):
    """Arrow batches a few rows at a time: what is made of their texts is freed
    again before the next ones."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def scan(texts: list[bytes], tables: Tables):
    """Yields (first, hashes, bounds, starts, data) for runs of texts of about
    RUN bytes: text ``first + i`` has the words ``hashes[bounds[i]:bounds[i + 1]]``,
    and word ``j`` starts at byte ``starts[j]`` of ``data``."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (held + len(texts[end]) <= RUN or end == at):
            held += len(texts[end]) + 1
            end += 1
        edges = np.cumsum([0] + [len(x) + 1 for x in texts[at:end]])
        data = b" ".join(texts[at:end])
        starts, hashes = _long(data, tables)
        yield at, hashes, np.searchsorted(starts, edges), starts, data
        at = end
