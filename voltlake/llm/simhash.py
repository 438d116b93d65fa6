"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two fingerprints at 4 or fewer differing bits differ
in four bytes at most, so they share four or more. Tallying single bytes would give every pair
that shares any one of them, a number that grows with the square of the input; the postings
here are of byte triples instead: the 20 triples of `TRIPLES` are such that every four
positions hold one of them (a Turan system), so each pair that reaches the guaranteed minimum
of four matches meets in a posting. There the matching bytes of its pairs are tallied, those
under four are dropped, and the rest are verified bit by bit.

Postings are of distinct fingerprints, so a text copied any number of times counts once. They
are sorted and streamed; a posting of more than `TILE` fingerprints is dealt into tiles of two
blocks each. A posting or tile returns a spanning forest of its links, never all pairs; no link
between components is lost, and connected components join the forests.

Defined results: a null or wordless text has the fingerprint zero and is linked like any
other. Fewer words than a shingle make one shingle of all. A text without doc_id gets its
group's component, null if no member has an id. Repeated rows are copies.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import arrow_limits, cut, fixed_width, table
from ._text import NOT_SPACE, U, blocks, lower, ragged, words
from .components import connected_components

SHINGLE = 4
MAX_BITS = 4
MIN_SHARED = 4
TILE = 1024
SEED = 42

#: XXH64's primes.
P1, P2, P3, P4, P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x, r: int):
    return (x << U(r)) | (x >> U(64 - r))


def xxh64(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte spans; spans of equal length are hashed together."""
    out = np.empty(len(starts), U)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    wide = np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))
    half = np.ndarray((len(buf) + 1,), "<u4", padded.data, strides=(1,))
    order = np.argsort(lengths, kind="stable")
    sizes, first = np.unique(lengths[order], return_index=True)
    with np.errstate(over="ignore"):
        for size, a, b in zip(sizes.tolist(), first, [*first[1:], len(order)]):
            rows = order[a:b]
            out[rows] = _xxh64_equal(padded, wide, half, starts[rows], size, seed)
    return out


def _xxh64_equal(buf, wide, half, at, size: int, seed: int):
    s = int(seed)
    mask = (1 << 64) - 1
    pos = 0
    rounds = lambda acc, lane: _rotl(acc + lane * P2, 31) * P1
    if size >= 32:
        v = [np.full(len(at), U(x & mask)) for x in (s + int(P1) + int(P2), s + int(P2), s, s - int(P1))]
        while pos + 32 <= size:
            for k in range(4):
                v[k] = rounds(v[k], wide[at + pos + 8 * k])
            pos += 32
        h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            h = (h ^ rounds(U(0), x)) * P1 + P4
    else:
        h = np.full(len(at), U((s + int(P5)) & mask))
    h = h + U(size)
    while pos + 8 <= size:
        h = _rotl(h ^ rounds(U(0), wide[at + pos]), 27) * P1 + P4
        pos += 8
    if pos + 4 <= size:
        h = _rotl(h ^ (half[at + pos].astype(U) * P1), 23) * P2 + P3
        pos += 4
    while pos < size:
        h = _rotl(h ^ (buf[at + pos].astype(U) * P5), 11) * P1
        pos += 1
    h = (h ^ (h >> U(33))) * P2
    h = (h ^ (h >> U(29))) * P3
    return h ^ (h >> U(32))


#: Each byte's eight bits, spread over the eight bytes of a word (bit j to byte j).
_SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).view("<u8").ravel().astype(U)


def majority(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """For each row the bits set in over half of its hashes."""
    out = np.zeros(n_rows, U)
    counts = np.bincount(rows, minlength=n_rows)
    if not len(hashes):
        return out
    # Runs of 255 hashes at most, so that a byte can hold a bit's count.
    pieces = -(-counts // 255)
    run, k = ragged(pieces)
    begin = (np.cumsum(counts) - counts)[run] + 255 * k
    has = counts[run] > 0
    begin, run = begin[has], run[has]
    by_byte = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    own = run[first]
    for j in range(8):
        spread = np.add.reduceat(_SPREAD[by_byte[:, j]], begin).astype("<u8")
        ones = np.add.reduceat(spread.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits = (2 * ones > counts[own][:, None]).astype(U)
        out[own] |= (bits << np.arange(8 * j, 8 * j + 8, dtype=U)).sum(axis=1, dtype=U)
    return out


def fingerprints_of(raw: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    n_rows = len(offsets) - 1
    buf = lower(raw)
    starts, ends, rows = words(buf, offsets, NOT_SPACE)
    if not len(starts):
        return np.zeros(n_rows, U)
    lengths = ends - starts
    # All words laid out with one space after each: a shingle is then a plain span.
    to = np.cumsum(lengths + 1) - (lengths + 1)
    joined = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
    run, k = ragged(lengths)
    joined[to[run] + k] = buf[starts[run] + k]
    counts = np.bincount(rows, minlength=n_rows)
    last = np.cumsum(counts)[rows] - 1
    head = np.r_[True, rows[1:] != rows[:-1]]
    i = np.arange(len(starts))
    full = i + shingle - 1 <= last
    use = np.flatnonzero(full | head)  # a row's first word stands for all of a short row
    tail = np.minimum(use + shingle - 1, last[use])
    return majority(xxh64(joined, to[use], to[tail] + lengths[tail] - to[use]), rows[use], n_rows)


def _fingerprint_step(batches):
    for part, raw, offsets in blocks(batches):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints_of(raw, offsets).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fp, the 64-bit fingerprint as a bigint, of every row."""
    arrow_limits(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(_fingerprint_step, "doc_id bigint, fp bigint")


def turan_triples() -> list[tuple[int, ...]]:
    """The 20 triples of eight positions such that any four positions hold one: positions in
    three near-equal rings; all inside one ring, or two in a ring with one of the next."""
    ring = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in itertools.combinations(range(8), 3):
        n = [sum(ring[p] == g for p in t) for g in range(3)]
        if 3 in n or any(n[g] == 2 and n[(g + 1) % 3] == 1 for g in range(3)):
            out.append(t)
    return out


TRIPLES = turan_triples()


def postings(distinct: DataFrame) -> DataFrame:
    """key, fp, id: a row for each fingerprint and triple; the key packs the triple's number
    and its three bytes."""
    byte = lambda p: F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(F.lit(255))
    keys = [F.lit(n << 24).bitwiseOR(F.shiftleft(byte(a), 16)).bitwiseOR(F.shiftleft(byte(b), 8)).bitwiseOR(byte(c)) for n, (a, b, c) in enumerate(TRIPLES)]
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp", "id")


def forest(fp: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the links among distinct fingerprints. The byte
    tally comes first; what reaches it is verified."""
    n = len(fp)
    if n == 2:
        x = int(fp[0]) ^ int(fp[1])
        return [(0, 1)] if x.bit_count() <= max_bits else []
    bytes_ = fp.astype("<u8").view(np.uint8).reshape(-1, 8)
    todo, out = np.arange(n), []
    while len(todo) > 1:
        front, todo = [int(todo[0])], todo[1:]
        while front and len(todo):
            i = front.pop()
            enough = (bytes_[todo] == bytes_[i]).sum(axis=1) >= MIN_SHARED
            linked = np.zeros(len(todo), bool)
            linked[enough] = np.bitwise_count(fp[todo[enough]] ^ fp[i]) <= max_bits
            front += todo[linked].tolist()
            out += [(i, int(j)) for j in todo[linked]]
            todo = todo[~linked]
    return out


def _links_step(names: tuple[str, ...]):
    """Rows sorted by key: a forest of each key's rows."""

    def run(batches):
        carry = None
        for b in batches:
            cols = [np.asarray(b.column(b.schema.get_field_index(c))) for c in names]
            if carry is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(carry, cols)]
            key = cols[:-2]
            new = np.r_[True, np.any([k[1:] != k[:-1] for k in key], axis=0)] if len(key[0]) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            if not len(at):
                continue
            yield from _forests(cols, at[:-1], at[1:])
            carry = [c[at[-1] :] for c in cols]
        if carry is not None and len(carry[0]):
            yield from _forests(carry, np.array([0]), np.array([len(carry[0])]))

    return run


def _forests(cols, begin, end):
    fp, ids = cols[-2].view(U), cols[-1]
    a, b = [], []
    for s, e in zip(begin, end):
        if e - s > 1:
            for i, j in forest(fp[s:e]):
                a.append(int(ids[s + i]))
                b.append(int(ids[s + j]))
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between ids that keep every component of the fingerprints' links whole."""
    p = postings(distinct)
    sizes = p.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("same")).where(F.col("n") > tile)
    hot = cut(sizes.groupBy("n", "same").agg(F.min("key").alias("key"), F.collect_list("key").alias("all")), "hot")  # postings of the same members once; a member set has 20 keys at most
    large = hot.select(F.explode("all").alias("key"))
    usual = p.join(large, "key", "left_anti").select("key", "fp", "id")
    usual = usual.repartition("key").sortWithinPartitions("key").mapInArrow(_links_step(("key", "fp", "id")), "a bigint, b bigint")
    m = F.ceil(F.col("n") / tile).cast("int")
    block = F.pmod(F.xxhash64("fp"), m).cast("int")
    dealt = p.join(hot.select("key", "n"), "key").withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), m - 1)))
    tiles = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "id")
    tiled = tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_links_step(("key", "i", "j", "fp", "id")), "a bigint, b bigint")
    return usual.unionAll(tiled)


def classes(documents: DataFrame, tile: int = TILE) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    prints = cut(fingerprints(documents), "prints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    component = connected_components(links(distinct.where("id is not null"), tile))
    of = distinct.join(component, F.col("id") == F.col("node"), "left").select(F.col("fp").alias("own_fp"), F.coalesce("component", "id").alias("component_id"))
    return prints.join(of, F.col("fp") == F.col("own_fp"), "left").select("doc_id", "fp", "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """The rows of `documents` whose id is their component's smallest, with their own columns.
    Rows without doc_id stay."""
    others = classes(documents).where("doc_id <> component_id").select("doc_id").distinct()
    return documents.join(others, "doc_id", "left_anti").select(*documents.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", fixed_width("fp").alias("fingerprint"), "component_id")
