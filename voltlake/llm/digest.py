"""Document fingerprints from improbable features.

Every window of 64 bytes is a feature. Its entropy, in thousandths of the most possible, is
compared with a histogram of the entropies of all windows of the corpus: the rarer its level,
the lower its rank. Of each 64 features in a row the leftmost of lowest rank scores a point,
and features of 16 points or more are selected, in the order of the text, once each. They are
put into a chain of Bloom filters of 2048 bits, 160 features a filter, 5 bits a feature.

Texts of under 2048 bytes have a second chain, made alike of windows of 12 bytes with 2 points
in rows of 8: half of such a text may have no whole window of 64 bytes. Those of under 128 have
a third, of all their windows of 5 bytes (`SCALES`).

Likeness of two filters: shared bits, normalised so that what chance gives is 0 and the most
possible is 1; of two chains: the mean, over the filters of the one with fewer features, weighed
by features, of the best likeness to a filter of the other; of two fingerprints: that of their
last chains of one kind that both have.

Defined results: a text without a selected feature takes its highest scoring one; one of less
than a window is a single feature; an empty or null text has the empty fingerprint, like itself
(1) and unlike all others (0). A text of any length is read whole. Equal texts have equal
fingerprints under one histogram. In the descending order of documents null ids come last and
equal ids, repeated rows too, in the order of their texts; an only document is its own next one.
Columns but doc_id and text are not read, so that their names can't clash.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import arrow_limits, table
from ._text import BLOCK_BYTES, U, blocks, sliding_min, span_hashes



@dataclass(frozen=True)
class Scale:
    """Features of one size, for texts of under so many bytes."""

    window: int
    run: int
    points: int
    under: int


SCALES = (Scale(64, 64, 16, 1 << 62), Scale(12, 8, 2, 2048), Scale(5, 1, 1, 128))
BITS = 2048
PER_FILTER = 160
SUBHASHES = 5
LEVELS = 1001
ROWS_PER_BLOCK = 4096
MAX_BLOCKS = 20_000
#: c * log2(c) in fixed point, so that running sums are exact.
_TERM = np.array([0, *(round(c * np.log2(c) * (1 << 24)) for c in range(1, 65))], np.int64)


def entropies(buf: np.ndarray, window: int = 64) -> np.ndarray:
    """The level of each window of `buf`, 0 to 1000, by its start; windows may cross rows."""
    n = len(buf) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    before, after = np.zeros(len(buf), np.uint8), np.zeros(len(buf), np.uint8)
    for d in range(1, window):
        same = (buf[d:] == buf[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    gain = np.diff(_TERM)
    added, removed = gain[before], gain[after]
    total = np.empty(n, np.int64)
    total[0] = _TERM[np.bincount(buf[:window], minlength=256)].sum()
    total[1:] = total[0] + np.cumsum(added[window:] - removed[: n - 1])
    most = _TERM[window]
    return ((most - total) * 1000) // most


def _valid(n: int, offsets: np.ndarray, window: int) -> np.ndarray:
    """Which of the block's windows lie in one row."""
    ok = np.ones(n, bool)
    for k in offsets[1:-1]:
        ok[max(0, k - window + 1) : k] = False
    return ok


def _of_scale(buf: np.ndarray, offsets: np.ndarray, scale: Scale) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a scale, their bytes and offsets."""
    sizes = np.diff(offsets)
    short = sizes < scale.under
    if short.all():
        return np.arange(len(sizes)), buf, offsets
    return np.flatnonzero(short), buf[np.repeat(short, sizes)], np.append(0, np.cumsum(sizes[short]))


def _histogram_step(batches):
    total = np.zeros((len(SCALES), LEVELS), np.int64)
    for _, raw, offsets in blocks(batches):
        for k, scale in enumerate(SCALES):
            _, buf, at = _of_scale(raw, offsets, scale)
            level = entropies(buf, scale.window)
            if len(level):
                total[k] += np.bincount(level[_valid(len(level), at, scale.window)], minlength=LEVELS)
    k, level = np.divmod(np.arange(total.size), LEVELS)
    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(level, pa.int32()), pa.array(total.ravel())], names=["scale", "level", "n"])


def entropy_histogram(documents: DataFrame) -> DataFrame:
    """scale, level, n: windows of each entropy level over all texts; 1001 rows a scale."""
    arrow_limits(documents.sparkSession)
    return documents.select("text").mapInArrow(_histogram_step, "scale int, level int, n bigint").groupBy("scale", "level").agg(F.sum("n").alias("n"))


def ranks(histogram: DataFrame) -> np.ndarray:
    """The rank of each level by scale, rarest first."""
    count = np.zeros((len(SCALES), LEVELS), np.int64)
    for r in histogram.collect():  # 1001 rows a scale
        count[r["scale"], r["level"]] = r["n"]
    out = np.empty_like(count)
    for k in range(len(SCALES)):
        out[k, np.lexsort((np.arange(LEVELS), count[k]))] = np.arange(LEVELS)
    return out


def features(buf: np.ndarray, offsets: np.ndarray, rank: np.ndarray, scale: Scale = SCALES[0]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the selected features of a block, in order."""
    n_rows, sizes = len(offsets) - 1, np.diff(offsets)
    rows, places, lengths = [np.flatnonzero((sizes > 0) & (sizes < scale.window))], [], []
    places.append(offsets[:-1][rows[0]])
    lengths.append(sizes[rows[0]])
    level = entropies(buf, scale.window)
    if len(level):
        shift = int(len(buf)).bit_length()
        ok = _valid(len(level), offsets, scale.window)
        key = np.where(ok, rank[level] << shift | np.arange(len(level)), np.int64(1) << 62)
        key = np.concatenate([key, np.full(scale.run - 1, np.int64(1) << 62)])
        best = sliding_min(key, scale.run)[ok] & ((1 << shift) - 1)
        points = np.bincount(best, minlength=len(level))
        at = np.flatnonzero(points)
        row = np.searchsorted(offsets, at, "right") - 1
        # A row without a feature of enough points takes its best.
        order = np.lexsort((at, -points[at], row))
        first = np.r_[True, row[order][1:] != row[order][:-1]] if len(at) else np.zeros(0, bool)
        chosen = points[at] >= scale.points
        has = np.zeros(n_rows, bool)
        has[row[chosen]] = True
        top = order[first]
        chosen[top[~has[row[top]]]] = True
        rows.append(row[chosen])
        places.append(at[chosen])
        lengths.append(np.full(int(chosen.sum()), scale.window))
    row, at, size = np.concatenate(rows), np.concatenate(places), np.concatenate(lengths)
    h = span_hashes(buf, at, at + size)
    order = np.lexsort((at, h, row))
    fresh = np.r_[True, (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])] if len(at) else np.zeros(0, bool)
    keep = np.sort(order[fresh])
    keep = keep[np.lexsort((at[keep], row[keep]))]
    return row[keep], h[keep]


#: Filters, as (scale, features, bits).
Chain = list[tuple[int, int, int]]


def chains(texts: list[bytes], rank: np.ndarray) -> list[Chain]:
    """For each text its filters, those of the first scale first."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    raw, out = np.frombuffer(b"".join(texts), np.uint8), [[] for _ in texts]
    for k, scale in enumerate(SCALES):
        mine, buf, at = _of_scale(raw, offsets, scale)
        row, h = features(buf, at, rank[k], scale)
        counts = np.bincount(row, minlength=len(mine))
        place = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
        n_filters = -(-counts // PER_FILTER)
        base = np.cumsum(n_filters) - n_filters
        number = base[row] + place // PER_FILTER
        bits = np.zeros(int(n_filters.sum()) * BITS, np.uint8)
        for i in range(SUBHASHES):
            bits[number * BITS + ((h >> U(11 * i)) & U(BITS - 1)).astype(np.int64)] = 1
        packed = np.packbits(bits).reshape(-1, BITS // 8)
        held = np.bincount(number, minlength=len(packed))
        filters = [(k, int(n), int.from_bytes(p.tobytes(), "big")) for n, p in zip(held, packed)]
        for i, b, n in zip(mine.tolist(), base.tolist(), n_filters.tolist()):
            out[i] += filters[b : b + n]
    return out


def fingerprint_text(chain: Chain) -> str:
    """Scale, features and bits of each filter, in base64, joined by dots."""
    return ".".join(f"{k}:{n}:{base64.b64encode(b.to_bytes(BITS // 8, 'big')).decode()}" for k, n, b in chain)


def parse_fingerprint(text: str) -> Chain:
    parts = (x.split(":") for x in text.split(".") if x)
    return [(int(k), int(n), int.from_bytes(base64.b64decode(b), "big")) for k, n, b in parts]


def _overlap(a: int, b: int) -> float:
    if a == b:
        return 1.0
    x, y = a.bit_count(), b.bit_count()
    chance, most = x * y / BITS, min(x, y)
    return max(0.0, ((a & b).bit_count() - chance) / (most - chance)) if most > chance else 0.0


def likeness(one: Chain, other: Chain) -> float:
    if not one or not other:
        return float(not one and not other)
    scale = max({k for k, _, _ in one} & {k for k, _, _ in other})  # all have the first
    one, other = ([(n, b) for k, n, b in x if k == scale] for x in (one, other))
    if sum(n for n, _ in one) > sum(n for n, _ in other) or (len(one) > len(other)):
        one, other = other, one
    return sum(n * max(_overlap(b, c) for _, c in other) for n, b in one) / sum(n for n, _ in one)


def likeness_text(one: str, other: str) -> float:
    """Likeness of two fingerprints in their text form."""
    return likeness(parse_fingerprint(one), parse_fingerprint(other))


def _pairs_step(rank_of):
    """Rows in order of block, edge and descending id: each row but a block's last with its next."""

    def outputs(rows):
        rank = rank_of.value
        use = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
        texts, edited = [r[3] for r in rows], []
        for i in use:
            t, n = texts[i], len(texts[i])
            edited.append(t[: n - n // 2] + texts[i + 1][: n // 2])
        coded = [e.encode() for e in edited]
        own, new = chains([t.encode() for t in texts], rank), chains(coded, rank)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in use], pa.int64()),
                pa.array([len(texts[i]) for i in use], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in coded], pa.string()),
                pa.array([fingerprint_text(own[i]) for i in use], pa.string()),
                pa.array([fingerprint_text(c) for c in new], pa.string()),
                pa.array([likeness(own[i], c) for i, c in zip(use, new)], pa.float64()),
                pa.array([likeness(own[i], own[i + 1]) for i in use], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches):
        held, size = [], 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                held.append(row)
                size += len(row[3])
                if size > BLOCK_BYTES and len(held) > 1:
                    yield outputs(held)
                    held = held[-1:]
                    size = len(held[0][3])
        if len(held) > 1:
            yield outputs(held)

    return run


def with_next(documents: DataFrame) -> DataFrame:
    """block, edge, doc_id, text: every row in a block of near ids, in descending order, and
    once more, as an edge, at the end of the block before. One shuffle of the texts."""
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("k"))
    total = rows.agg(F.count("*").alias("n"), F.max("k").alias("top")).first()
    n = min(MAX_BLOCKS, max(1, -(-total["n"] // ROWS_PER_BLOCK)))
    ends = []
    if n > 1:  # these are ids of rows, so each is the largest of its block
        ends = rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n)).first()[0]
    ends = np.unique(np.array([e for e in ends if e < total["top"]], np.int64))
    top = total["top"]

    @F.pandas_udf("array<int>")
    def block_of(k: pd.Series) -> pd.Series:
        ids = k.to_numpy(np.int64)
        own = np.searchsorted(ends, ids)
        end = np.append(ends, top)[own] == ids
        return pd.Series([[int(b), int(b + 1) if b < len(ends) else 0] if e else [int(b)] for b, e in zip(own, end)])

    spread = rows.withColumn("blocks", block_of("k")).select("doc_id", "text", "k", F.posexplode("blocks").alias("edge", "block"))
    return spread.repartition("block").sortWithinPartitions("block", "edge", F.desc("k"), "text").select("block", "edge", "doc_id", "text")


def digest_documents(documents: DataFrame) -> DataFrame:
    """The contract's columns for every document, its edited text and its next document."""
    spark = documents.sparkSession
    arrow_limits(spark)
    rank = spark.sparkContext.broadcast(ranks(entropy_histogram(documents)))
    return with_next(documents).mapInArrow(
        _pairs_step(rank), "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def _digest_step(rank_of):
    def run(batches):
        for part, raw, offsets in blocks(batches):
            found = chains([raw[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], rank_of.value)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(fingerprint_text, found), pa.string())], names=["doc_id", "fingerprint"])

    return run


def fingerprints(documents: DataFrame, histogram: DataFrame | None = None) -> DataFrame:
    """doc_id and fingerprint of every row, under the corpus's own or a given histogram."""
    spark = documents.sparkSession
    arrow_limits(spark)
    rank = spark.sparkContext.broadcast(ranks(entropy_histogram(documents) if histogram is None else histogram))
    return documents.select("doc_id", "text").mapInArrow(_digest_step(rank), "doc_id bigint, fingerprint string")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
