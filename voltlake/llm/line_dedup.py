"""Line dedup: one line stays of each component of near-equal lines.

Every line that is not blank is known by a 128-bit key. Its character shingles (lower-cased)
are hashed once each into a one-permutation MinHash signature, empty bins borrowing from the
next full one; bands of the signature are the buckets. Lines that share a bucket are compared
by the exact Jaccard similarity of their shingle sets, and connected components join the
links of `SIMILARITY` or more. Of a component's lines the one in the document of smallest id
stays, and there the first; blank lines stay.

Equal lines are taken once a block, and are one row from the first aggregation on. Buckets are
sorted and streamed, in chunks of about `CHUNK` lines, a line of many bytes counting as several
(`LINE_BYTES`); what is then still apart in a larger bucket is compared across components in
tiles of two blocks. A chunk or tile returns a spanning forest of its links, so no link between
components is lost and no list of all pairs is made. What is decided about lines meets the
documents in one stream: by a broadcast table if it has at most `SHARED_LINES` rows, else by
joins, with the same result.

Defined results: a null text has no lines and stays null; an empty one has a single blank
line. Rows without doc_id take no part and stay whole. Rows of one doc_id share the fate of
its lines. A text whose lines all go becomes empty. Lines shorter than a shingle are one
shingle. A line is never cut, however long: its shingles are hashed window by window.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from ._spark import arrow_limits, cut, table
from ._text import U, blocks, mix
from .components import connected_components

SHINGLE = 9
SIMILARITY = 0.8
BANDS = 12
ROWS = 5
BINS = BANDS * ROWS
KEY_BITS = 48
CHUNK = 256
TILE = 1024
#: A line counts once more in its chunk for every so many bytes.
LINE_BYTES = 1 << 14
SHARED_LINES = 1_000_000
BLOCK_BYTES = 1 << 19
#: Code points that are hashed at once.
STRIDE = 1 << 16
#: Groups of at most so many lines are compared by their shingles, larger ones by bit sets of those that are shared.
FEW = 6
SALTS = 16
BAND_NAMES = [f"b{i}" for i in range(BANDS)]


def split_lines(data: bytes, a: int, b: int) -> Iterator[bytes]:
    """The lines of data[a:b], one at a time."""
    while (c := data.find(b"\n", a, b)) >= 0:
        yield data[a:c]
        a = c + 1
    yield data[a:b]


class Lines:
    """The distinct lines of a block in order of appearance, and the number of the line at
    each place of each row; every row has one place at least."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        data, index = raw.tobytes(), {}
        number, counts = array("i"), []
        for a, b in pairwise(offsets.tolist()):
            before = len(number)
            number.extend(index.setdefault(x, len(index)) for x in split_lines(data, a, b))
            counts.append(len(number) - before)
        self.texts: list[bytes] = list(index)
        self.number = np.frombuffer(number, np.int32) if number else np.zeros(0, np.int32)
        self.counts = np.array(counts, np.int64)
        self.rows = np.repeat(np.arange(len(counts)), self.counts)
        self.blank = np.array([not t or t.isspace() for t in self.texts], bool)
        keys = np.frombuffer(b"".join(map(xxh3_128_digest, self.texts)), "<i8").reshape(-1, 2)
        self.k1, self.k2 = np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1])

    def in_rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Line and row of every line that is not blank in every row that has it, by line."""
        wide = max(1, len(self.counts))
        line, row = np.divmod(np.unique(self.number.astype(np.int64) * wide + self.rows), wide)
        use = ~self.blank[line]
        return line[use], row[use]


def _windows(cp: np.ndarray, kind: type, base: int) -> np.ndarray:
    """A polynomial hash of every `SHINGLE` code points in a row."""
    whole = cp.astype(kind)
    whole += kind(1)
    h, width, power = whole, 1, base
    with np.errstate(over="ignore"):
        while 2 * width <= SHINGLE:
            nxt = h[:-width] * kind(power)
            nxt += h[width:]
            h, width, power = nxt, 2 * width, power * power % (1 << 8 * np.dtype(kind).itemsize)
        for k in range(width, SHINGLE):
            h = h[:-1] * kind(base)
            h += whole[k:]
    return h


def _spread(h: np.ndarray) -> np.ndarray:
    """Mixes 32-bit values in place."""
    with np.errstate(over="ignore"):
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
            h ^= h >> np.uint32(shift)
            h *= np.uint32(factor)
        h ^= h >> np.uint32(16)
    return h


def shingles(texts: list[bytes], bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles each line has, and the hashes of all of them, line after line; with
    32 bits they are mixed, for a signature."""
    kind, base = (np.uint64, 0xD1342543DE82EF95) if bits == 64 else (np.uint32, 0x9E3779B1)
    buf = b"\n".join(texts).lower()
    cp = np.frombuffer(buf, np.uint8) if buf.isascii() else np.frombuffer(buf.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    ends = np.append(np.flatnonzero(cp == 10), len(cp))
    counts = np.maximum(np.diff(ends, prepend=-1) - SHINGLE, 0)
    n = max(0, len(cp) - SHINGLE + 1)
    inside = np.ones(n, bool)
    for k in range(SHINGLE):  # no window crosses a line's end
        last = ends - k
        inside[last[(last >= 0) & (last < n)]] = False
    found = [np.zeros(0, kind)]
    for a in range(0, n, STRIDE):
        h = _windows(cp[a : a + STRIDE + SHINGLE - 1], kind, base)
        h = h[inside[a : a + STRIDE]]
        found.append(_spread(h) if bits == 32 else h)
    out = np.concatenate(found)
    short = np.flatnonzero(counts == 0)
    if len(short):
        whole = np.array([xxh3_64_intdigest(texts[i].lower()) for i in short.tolist()], U)
        out = np.insert(out, (np.cumsum(counts) - counts)[short], whole.astype(kind) if bits == 64 else (whole >> U(32)).astype(kind))
        counts[short] = 1
    return counts, out


def signatures(counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of each line: the least of its 32-bit hashes in each bin, empty
    bins filled from the right."""
    empty, n = np.uint32(0xFFFFFFFF), len(counts)
    least = np.full(n * BINS, empty, np.uint32)
    place = np.repeat(np.arange(n) * BINS, counts)
    place += (hashes >> np.uint32(16)) * np.uint32(BINS) >> np.uint32(16)
    np.minimum.at(least, place, hashes)
    out = least.reshape(n, BINS).astype(U)
    holes = np.flatnonzero((least.reshape(n, BINS) == empty).any(axis=1))
    if len(holes):
        twice = np.concatenate([out[holes]] * 2, axis=1)
        at = np.where(twice != U(empty), np.arange(2 * BINS), 4 * BINS)
        nearest = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :BINS]
        nearest = np.minimum(nearest, 2 * BINS - 1)  # all bins empty: a hash that is itself the largest
        away = (nearest - np.arange(BINS)).astype(U)
        out[holes] = np.take_along_axis(twice, nearest, axis=1) + away * U(0x9E3779B97F4A7C15)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """Bucket of each band: the band's number and `KEY_BITS` bits."""
    h = np.zeros((len(signature), BANDS), U)
    by_band = signature.reshape(-1, BANDS, ROWS)
    for r in range(ROWS):
        h = mix(h * U(0xD1342543DE82EF95) + by_band[:, :, r] + U(1))
    return (h & U((1 << KEY_BITS) - 1)) | (np.arange(BANDS, dtype=U) << U(KEY_BITS))


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _line_step(batches):
    for part, raw, offsets in blocks(batches, limit=BLOCK_BYTES):
        own = Lines(raw, offsets)
        line, row = own.in_rows()
        if not len(line):
            continue
        first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        use = line[first]
        ids = part.column(0).to_numpy()[row]
        texts = [own.texts[k] for k in use.tolist()]
        keys = band_keys(signatures(*shingles(texts, 32)))
        weight = np.array([1 + len(t) // LINE_BYTES for t in texts], np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.minimum.reduceat(ids, first)), pa.array(np.diff(np.append(first, len(line)))), pa.array(own.k1[use]), pa.array(own.k2[use]),
                pa.array(weight), *(_i64(np.ascontiguousarray(keys[:, i])) for i in range(BANDS)),
            ],
            names=["first_doc", "n_docs", "k1", "k2", "weight", *BAND_NAMES],
        )


def _key_step(batches):
    for part, raw, offsets in blocks(batches):
        own = Lines(raw, offsets)
        line, row = own.in_rows()
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(own.k1[line]), pa.array(own.k2[line])], names=["doc_id", "k1", "k2"])


def line_table(documents: DataFrame) -> DataFrame:
    """k1, k2, first_doc, n_docs, weight and the bands of every distinct line."""
    fields = ", ".join(f"{b} bigint" for b in BAND_NAMES)
    rows = documents.select("doc_id", "text").mapInArrow(_line_step, f"first_doc bigint, n_docs bigint, k1 bigint, k2 bigint, weight int, {fields}")
    return rows.groupBy("k1", "k2").agg(F.min("first_doc").alias("first_doc"), F.sum("n_docs").alias("n_docs"), *(F.first(b).alias(b) for b in ["weight", *BAND_NAMES]))


def _shared_step(batches):
    """Of rows sorted by their first column those whose key is not theirs alone."""
    held = None
    for b in batches:
        names = b.schema.names
        cols = [np.asarray(b.column(i)) for i in range(b.num_columns)]
        if held is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(held[1], cols)]
        key = cols[0]
        if not len(key):
            continue
        same = np.r_[False, key[1:] == key[:-1]]
        if held is not None:
            same[0] = held[0]
        keep = same | np.r_[same[1:], False]
        last = len(key) - 1  # the last row waits for the next one
        use = np.flatnonzero(keep[:last])
        yield pa.RecordBatch.from_arrays([pa.array(c[use]) for c in cols], names=names)
        held = (bool(same[last]), [c[last:] for c in cols])
    if held is not None and held[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[1]], names=names)


def shared_buckets(line_rows: DataFrame) -> DataFrame:
    """key, k1, k2, n: the buckets of two lines or more, n their weight; of equal buckets one."""
    spread = line_rows.select(F.explode(F.array(*BAND_NAMES)).alias("key"), "k1", "k2", "weight")
    shared = cut(spread.repartition("key").sortWithinPartitions("key").mapInArrow(_shared_step, "key bigint, k1 bigint, k2 bigint, weight int"), "shared")
    sizes = shared.groupBy("key").agg(F.sum("weight").alias("n"), F.bit_xor(F.xxhash64("k1", "k2")).alias("x"), F.bit_xor(F.xxhash64("k2", "k1")).alias("y"))
    some = sizes.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    return shared.join(some, "key").select("key", "k1", "k2", "n")


class Decisions:
    """Rows (k1, k2, ...) sorted for look-up."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray, *values: np.ndarray) -> None:
        order = np.argsort(k1)
        self.k1, self.k2 = k1[order], k2[order]
        self.values = [v[order] for v in values]

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        if not len(self.k1):
            return np.full(len(k1), -1)
        at = np.minimum(np.searchsorted(self.k1, k1), len(self.k1) - 1)
        return np.where((self.k1[at] == k1) & (self.k2[at] == k2), at, -1)


def _gather(df: DataFrame, *columns: str) -> Decisions:
    """A bounded table as arrays; the callers have counted it."""
    t = df.select(*columns).toArrow()
    return Decisions(*(t[c].to_numpy() for c in columns))


def _find(own: Lines, part, shared) -> tuple[np.ndarray, Decisions]:
    """Each line's place among the decisions: those of all, or those joined to the rows."""
    if shared is not None:
        found = shared.value
    else:
        flat = part.column(part.schema.get_field_index("told")).flatten()
        found = Decisions(*(np.asarray(flat.field(i)) for i in range(flat.type.num_fields)))
    return np.where(own.blank, -1, found.find(own.k1, own.k2)), found


def _text_step(shared):
    """Texts of wanted lines, from the document that has them first."""

    def run(batches):
        for part, raw, offsets in blocks(batches):
            own = Lines(raw, offsets)
            at, found = _find(own, part, shared)
            line, row = own.in_rows()
            ids = part.column(0).to_numpy()
            some = np.flatnonzero(at[line] >= 0)
            some = some[found.values[0][at[line[some]]] == ids[row[some]]]
            use = line[some]
            yield pa.RecordBatch.from_arrays([pa.array(own.k1[use]), pa.array(own.k2[use]), pa.array([own.texts[k].decode("utf-8", "replace") for k in use.tolist()], pa.string())], names=["k1", "k2", "line"])

    return run


def line_texts(documents: DataFrame, wanted: DataFrame, shared_lines: int) -> DataFrame:
    """k1, k2, line of the wanted lines (k1, k2, first_doc)."""
    out = "k1 bigint, k2 bigint, line string"
    if wanted.count() <= shared_lines:
        shared = documents.sparkSession.sparkContext.broadcast(_gather(wanted, "k1", "k2", "first_doc"))
        return documents.mapInArrow(_text_step(shared), out)
    told = wanted.groupBy(F.col("first_doc").alias("doc_id")).agg(F.collect_list(F.struct("k1", "k2", "first_doc")).alias("told"))  # of one document
    return documents.join(told, "doc_id").mapInArrow(_text_step(None), out)


def _told(documents: DataFrame, decisions: DataFrame, columns: list[str]) -> DataFrame:
    """Documents with the decisions about their lines, by joins: for tables of any size."""
    occurs = documents.select("doc_id", "text").where("doc_id is not null").mapInArrow(_key_step, "doc_id bigint, k1 bigint, k2 bigint").distinct()
    told = occurs.join(decisions, ["k1", "k2"]).groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("told"))  # of one document
    return documents.join(told, "doc_id", "left")


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The shingles of each line, sorted, each once."""
    counts, hashes = shingles(texts)
    out = []
    for a, b in pairwise([0, *np.cumsum(counts).tolist()]):
        x = np.sort(hashes[a:b])
        out.append(x[np.append(True, x[1:] != x[:-1])])
    return out


def _near(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-6:
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = np.count_nonzero(both[1:] == both[:-1])
    return same >= similarity * (len(both) - same) - 1e-6


def _shared_bits(sets: list[np.ndarray]) -> np.ndarray:
    """For each line, as bits, which it has of the shingles that two lines or more have."""
    n = len(sets)
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times[number] > 1
    run, number = np.repeat(np.arange(n), [len(x) for x in sets])[often], (np.cumsum(times > 1) - 1)[number[often]]
    order = np.argsort(number, kind="stable")
    run, number = run[order], number[order]
    total = int(number[-1]) + 1 if len(number) else 0
    out = []
    for first in range(0, total, 4096):
        wide = min(4096, -(-(total - first) // 64) * 64)
        a, b = np.searchsorted(number, [first, first + wide])
        has = np.zeros((n, wide), np.uint8)
        has[run[a:b], number[a:b] - first] = 1
        out.append(np.packbits(has, axis=1).view(U))
    return np.concatenate(out, axis=1) if out else np.zeros((n, 0), U)


def forest(sets: list[np.ndarray], label: np.ndarray | None = None, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the links among lines, given by their shingles.
    Lines of one label are known to be connected: they are not compared with one another."""
    n = len(sets)
    if n <= FEW:
        root, out = list(range(n)) if label is None else [int(np.argmax(label == x)) for x in label], []
        for j in range(1, n):
            for i in range(j):
                if root[i] != root[j] and _near(sets[i], sets[j], similarity):
                    out.append((i, j))
                    root = [root[i] if x == root[j] else x for x in root]
        return out
    size, bits = np.array([len(x) for x in sets], np.float64), _shared_bits(sets)
    todo, out = np.arange(n), []
    while len(todo) > 1:
        front, todo = [int(todo[0])], todo[1:]
        while front and len(todo):
            i = front.pop()
            if label is not None:
                mate = label[todo] == label[i]
                front += todo[mate].tolist()
                todo = todo[~mate]
            both = np.bitwise_count(bits[todo] & bits[i]).sum(axis=1, dtype=np.int64)
            linked = both >= similarity * (size[todo] + size[i] - both) - 1e-6
            found = todo[linked].tolist()
            front += found
            out += [(i, j) for j in found]
            todo = todo[~linked]
    return out


def _links_of(rows: pa.Table, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links of the groups that begin at the given rows, about a block of text at a time."""
    ids = np.column_stack([rows["k1"].to_numpy(), rows["k2"].to_numpy()])
    label = None if rows["label"].null_count else rows["label"].to_numpy()
    texts = rows["line"].cast(pa.binary()).to_pylist()
    upto = np.cumsum([0, *map(len, texts)])
    edges, a = np.append(begin, len(texts)), 0
    while a < len(begin):
        z = max(a + 1, int(np.searchsorted(upto[edges], upto[edges[a]] + BLOCK_BYTES, "right")) - 1)
        lo, hi = int(edges[a]), int(edges[z])
        distinct: dict[tuple[int, int], int] = {}
        number = [distinct.setdefault(k, len(distinct)) for k in map(tuple, ids[lo:hi].tolist())]
        where = np.zeros(len(distinct), np.int64)
        where[number] = np.arange(lo, hi)
        sets = shingle_sets([texts[i] for i in where.tolist()])
        pairs = []
        for s, e in pairwise((edges[a : z + 1] - lo).tolist()):
            mine = list(dict.fromkeys(number[s:e]))
            if len(mine) > 1:
                told = None if label is None else label[where[mine]]
                pairs += [(mine[i], mine[j]) for i, j in forest([sets[k] for k in mine], told)]
        if pairs:
            ends = ids[where[np.array(pairs)]]
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, i, k]) for i in (0, 1) for k in (0, 1)], names=["a1", "a2", "b1", "b2"])
        a = z


def _link_step(n_keys: int):
    """Rows (keys..., k1, k2, label, line) sorted by keys: a forest of each group."""

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of one group, the last
        for b in batches:
            if not b.num_rows:
                continue
            keys = [np.asarray(b.column(i)) for i in range(n_keys)]
            fresh = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            if held and any(held[-1].column(i)[-1].as_py() != k[0] for i, k in enumerate(keys)):
                yield from _links_of(pa.Table.from_batches(held).combine_chunks(), np.array([0]))
                held = []
            if not len(fresh):
                held.append(b)
                continue
            last = int(fresh[-1])
            rows = pa.Table.from_batches([*held, b.slice(0, last)]).combine_chunks()
            more = rows.num_rows - last
            yield from _links_of(rows, np.append(0, fresh[:-1] + more))
            held = [b.slice(last)]
        if held:
            yield from _links_of(pa.Table.from_batches(held).combine_chunks(), np.array([0]))

    return run


LINKS = "a1 bigint, a2 bigint, b1 bigint, b2 bigint"


def _linked(rows: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    rows = rows.join(texts, ["k1", "k2"]).select(*keys, "k1", "k2", "label", "line")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_link_step(len(keys)), LINKS)


def as_edges(found: DataFrame) -> DataFrame:
    return found.select(F.xxhash64("a1", "a2").alias("a"), F.xxhash64("b1", "b2").alias("b"))


def line_components(buckets: DataFrame, texts: DataFrame, chunk: int = CHUNK, tile: int = TILE) -> DataFrame:
    """node, component of the linked lines; a line's node is xxhash64(k1, k2).

    First every bucket's lines are compared within chunks, which is all there is to do for
    buckets of one. Large buckets that are not yet of one component then compare lines of
    different components, in tiles of two blocks."""
    m = F.ceil(F.col("n") / chunk).cast("int")
    node = F.xxhash64("k1", "k2")
    one = cut(_linked(buckets.withColumn("i", F.pmod(node, m).cast("int")).withColumn("label", F.lit(None).cast("bigint")), texts, ["key", "i"]), "links")
    component = connected_components(as_edges(one))
    large = buckets.where(F.col("n") > chunk).join(component, node == F.col("node"), "left").withColumn("label", F.coalesce("component", node)).select("key", "k1", "k2", "n", "label")
    apart = large.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
    large = cut(large.join(apart, "key"), "apart")
    if large.isEmpty():
        return component
    m = F.ceil(F.col("n") / tile).cast("int")
    dealt = large.withColumn("own", F.pmod(F.xxhash64("k2", "k1"), m).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), m - 1)))
    tiles = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select("key", "i", "j", "k1", "k2", "label")
    more = as_edges(cut(_linked(tiles, texts, ["key", "i", "j"]), "links"))
    return connected_components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))


def decide(documents: DataFrame, chunk: int = CHUNK, tile: int = TILE, shared_lines: int = SHARED_LINES) -> DataFrame:
    """k1, k2, owner, component of every line that more than one document has, or that has
    near-equal lines: it stays in the owner alone, and there once for its component."""
    found = cut(line_table(documents), "lines")
    buckets = cut(shared_buckets(found), "buckets")
    wanted = buckets.select("k1", "k2").distinct().join(found.select("k1", "k2", "first_doc"), ["k1", "k2"])
    texts = cut(line_texts(documents, cut(wanted, "wanted"), shared_lines), "texts")
    component = line_components(buckets, texts, chunk, tile)
    many = found.select("k1", "k2", "first_doc", "n_docs").join(component, F.xxhash64("k1", "k2") == F.col("node"), "left").where("node is not null or n_docs > 1")
    many = cut(many.select("k1", "k2", "first_doc", "component"), "many")
    alone = many.where("component is null").select("k1", "k2", F.col("first_doc").alias("owner"), F.col("k1").alias("component"))
    linked = many.where("component is not null").withColumn("salt", F.pmod("k1", F.lit(SALTS)))
    owners = linked.groupBy("component", "salt").agg(F.min("first_doc").alias("owner")).groupBy("component").agg(F.min("owner").alias("owner"))
    owners = owners.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))  # a component may hold a third of the lines
    return alone.unionByName(linked.join(owners, ["component", "salt"]).select("k1", "k2", "owner", "component"))


def _rewrite_step(shared):
    def run(batches):
        for part, raw, offsets in blocks(batches):
            own = Lines(raw, offsets)
            at, found = _find(own, part, shared)
            known, n = at >= 0, part.num_rows
            owner, label = np.zeros(len(at), np.int64), np.arange(len(at))
            owner[known] = found.values[0][at[known]]
            label[known] = len(at) + np.unique(found.values[1][at[known]], return_inverse=True)[1]
            ids = part.column(0)
            none = np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy()
            places = own.rows * (2 * len(at)) + label[own.number]
            keep = np.zeros(len(places), bool)
            keep[np.unique(places, return_index=True)[1]] = True
            keep &= ~(known[own.number] & (owner[own.number] != ids[own.rows]))
            keep |= own.blank[own.number] | none[own.rows]
            n_lines, n_kept = own.counts.copy(), np.bincount(own.rows, weights=keep, minlength=n).astype(np.int64)
            texts = part.column(part.schema.get_field_index("text"))
            null = np.asarray(texts.is_null())
            n_lines[null] = n_kept[null] = 0
            changed = np.flatnonzero(n_kept < n_lines)
            first = np.cumsum(own.counts) - own.counts
            new = []
            for i in changed.tolist():
                mine = slice(first[i], first[i] + own.counts[i])
                new.append(b"\n".join([own.texts[k] for k in own.number[mine][keep[mine]].tolist()]).decode("utf-8", "replace"))
            if new:
                mask = np.zeros(n, bool)
                mask[changed] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type))
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("row")), pa.array(n_lines), pa.array(n_kept), texts.cast(pa.string())], names=["row", "n_lines", "n_kept", "kept_text"])

    return run


def rewrite(documents: DataFrame, chunk: int = CHUNK, tile: int = TILE, shared_lines: int = SHARED_LINES) -> DataFrame:
    """row (the document's columns but its text), n_lines, n_kept and kept_text of every document."""
    arrow_limits(documents.sparkSession)
    decisions = cut(decide(documents.select("doc_id", "text").where("doc_id is not null"), chunk, tile, shared_lines), "decided")
    rows = documents.select("doc_id", "text", F.struct(*(F.col(c) for c in documents.columns if c != "text")).alias("row"))
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string("n_lines bigint, n_kept bigint, kept_text string").fields])
    if decisions.count() <= shared_lines:
        shared = documents.sparkSession.sparkContext.broadcast(_gather(decisions, "k1", "k2", "owner", "component"))
        return rows.mapInArrow(_rewrite_step(shared), schema)
    return _told(rows, decisions, ["k1", "k2", "owner", "component"]).mapInArrow(_rewrite_step(None), schema)


def dedup_lines(documents: DataFrame, chunk: int = CHUNK, tile: int = TILE, shared_lines: int = SHARED_LINES) -> DataFrame:
    """`documents` with the lines that stay; n_chars, if it is there, follows."""
    new = {"text": F.col("kept_text")}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.length("kept_text").cast(documents.schema["n_chars"].dataType)
    return rewrite(documents, chunk, tile, shared_lines).select(*(new.get(c, F.col("row")[c]).alias(c) for c in documents.columns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_kept and the digest of the text that stays, of every document."""
    out = rewrite(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
