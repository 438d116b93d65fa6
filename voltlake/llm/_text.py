"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on the UTF-8 bytes of a block of rows at once: `blocks` cuts Arrow
batches into blocks of bounded size, `words` finds word spans without crossing rows, and
`span_hashes` hashes any number of byte spans from two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 1 << 20
_BASES = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def byte_class(pred) -> np.ndarray:
    return np.array([bool(pred(b)) for b in range(256)])


#: Words `[^\x20\x09-\x0D]+`.
NOT_SPACE = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES):
    """Yield (rows, bytes, offsets): slices of the batches whose texts have `limit` bytes at
    most, one row at least. A null text counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        if texts.null_count:
            texts = texts.fill_null("")
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            to = min(to, len(texts))
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return np.frombuffer(buf.tobytes().translate(LOWER), dtype=np.uint8)


def words(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes of a kind; runs stop at row ends."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = kind[buf]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | fresh[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        base = _BASES[which]
        inverse = U(pow(int(base), -1, 1 << 64))
        out = []
        for b in (base, inverse):
            p = np.full(size, b, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 8 * BLOCK_BYTES:
            _POWERS[which] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(buf: np.ndarray, which: int = 0) -> np.ndarray:
    powers, _ = _powers(which, len(buf) + 1)
    out = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * powers[: len(buf)], out=out[1:])
    return out


def span_hashes(buf, starts, ends, which: int = 0, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the byte spans; equal spans have equal hashes wherever they lie."""
    sums = prefix_sums(buf, which) if sums is None else sums
    _, inverse = _powers(which, len(buf) + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every i with a full window."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given lengths laid end to end: each cell's run and its place in it."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return run, np.arange(len(run)) - np.repeat(first, lengths)
