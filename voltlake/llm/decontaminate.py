"""Benchmark decontamination by winnowed fingerprints.

Every window of `window` consecutive benchmark words (a shorter item is one window) must be
found wherever it occurs in a document. For a window of L words both sides hash k-grams of
k = ceil(L/2) words and keep the smallest hash of each run of L-k+1 k-grams, so that any shared
span of L words has a kept k-gram in common. A document's kept k-grams that the benchmark has
are hits; each is extended to the windows that hold it, and those of them that the benchmark
has, by 128 bits of hash, mark their words and their items. The work on a document grows with
its words and its result, however often a word or a passage is repeated on either side.

A benchmark of at most `block_bytes` of text is indexed in one broadcast, and the documents
stream past it without a shuffle. A larger one is never gathered: its kept k-grams become a
bitmap of fixed size (`FILTER_WORDS`), one pass over the documents keeps the windows around
hits, and these are joined to the benchmark's windows. Both ways give the same rows.

Defined results: a null or wordless text has no words, hits or items. Items that are null or
wordless never occur. Items with a null id don't take part; repeated items count once. Rows are
judged one by one, so repeated rows get the same answer, with or without an id. A text of any
length is judged whole. Extra columns of `documents` pass through; clashing names of the added
columns are replaced.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import arrow_limits, cut, table
from ._text import ALNUM, U, blocks, lower, mix, ragged, sliding_min, span_hashes, words

WINDOW = 13
BLOCK_BYTES = 8 << 20
#: 64-bit words of the bitmap of a large benchmark's k-grams: 32 MB.
FILTER_WORDS = 1 << 22
ADDED = "n_words bigint, hit_spans array<bigint>, hit_items array<string>, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
NAMES = [x.split()[0] for x in ADDED.split(", ")]


def gram_sizes(length: int) -> tuple[int, int]:
    """Words per k-gram and k-grams per kept minimum for windows of `length` words."""
    k = math.ceil(length / 2)
    return k, length - k + 1


def winnow(word_hashes: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams kept: each one that is the minimum of some full
    window of `length` words of one row."""
    k, w = gram_sizes(length)
    n = len(word_hashes) - k + 1
    if len(word_hashes) < length:
        return np.zeros(0, np.int64), np.zeros(0, U)
    grams = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for j in range(k):
            grams = grams * U(0x9FB21C651E98DF25) + word_hashes[j : j + n]
    grams = mix(grams) | U(1)
    least = sliding_min(grams, w)
    least = np.where(rows[: len(least)] == rows[length - 1 :], least, U(0))
    padded = np.concatenate([np.zeros(w - 1, U), least, np.zeros(w - 1, U)])
    kept = np.flatnonzero(~sliding_min(~padded, w) == grams)  # the largest minimum over the windows that hold it
    return kept, grams[kept]


class Words:
    """The words of a block: two hashes of each, its row, and each row's words."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        self.buf = lower(raw)
        self.starts, self.ends, self.rows = words(self.buf, offsets, ALNUM)
        self.n_words = np.bincount(self.rows, minlength=len(offsets) - 1)
        self.base = np.cumsum(self.n_words) - self.n_words
        self.h = span_hashes(self.buf, self.starts, self.ends) if len(self.starts) else np.zeros(0, U)
        self.g: np.ndarray | None = None

    def windows(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the `length` words from each place."""
        if self.g is None:
            self.g = span_hashes(self.buf, self.starts, self.ends, 1)
        out = []
        with np.errstate(over="ignore"):
            for x, factor in ((self.h, 0xA0761D6478BD642F), (self.g, 0xE7037ED1A0B428DB)):
                total = np.full(len(at), U(length))
                for j in range(length):
                    total = total * U(factor) + x[at + j]
                out.append(mix(total))
        return out[0], out[1]

    def around(self, hits: np.ndarray, length: int) -> np.ndarray:
        """Places of all windows of `length` words, of one row, that hold the k-gram of a hit."""
        if not len(hits):
            return hits
        k, w = gram_sizes(length)
        row = self.rows[hits]
        first = np.maximum(hits + k - length, self.base[row])
        last = np.minimum(hits, self.base[row] + self.n_words[row] - length)
        run, i = ragged(np.maximum(last - first + 1, 0))
        return np.unique(first[run] + i)


def _lengths(n_words: np.ndarray, window: int) -> np.ndarray:
    return np.minimum(n_words, window)


def _item_windows(own: Words, window: int):
    """For each length the places of the items' windows of that length."""
    size = _lengths(own.n_words, window)
    for length in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == length)
        run, i = ragged(own.n_words[rows] - length + 1)
        yield length, own.base[rows][run] + i


def _item_grams(own: Words, window: int):
    """For each length the kept k-grams of the items of that length."""
    size = _lengths(own.n_words, window)
    for length in np.unique(size[size > 0]).tolist():
        at, found = winnow(own.h, own.rows, length)
        yield length, found[size[own.rows[at]] == length]


def _sorted_in(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Each value's place among sorted keys, -1 for none."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


class Index:
    """A benchmark's fingerprints and windows. items: id and text of each; ids may repeat."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        names = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(names)}
        self.names = np.array(names, object)
        data = [(t or "").encode() for _, t in items]
        own = Words(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64))
        of_row = np.array([number[i] for i, _ in items], np.int64)
        grams = dict(_item_grams(own, window))
        self.classes = []
        for length, at in _item_windows(own, window):
            h, g = own.windows(at, length)
            item = of_row[own.rows[at]]
            order = np.lexsort((item, g, h))
            h, g, item = h[order], g[order], item[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
            fresh = new | np.r_[True, item[1:] != item[:-1]]  # an item that repeats a window has it once
            first = np.flatnonzero(new[fresh])
            item = item[fresh]
            self.classes.append((length, np.unique(grams[length]), h[new], g[new], first, np.diff(np.append(first, len(item))), item))

    def search(self, own: Words):
        """Yield (places, length, rows, item numbers): the windows of a length that the
        benchmark has, and, once each, the rows and items that they make known."""
        for length, grams, h, g, first, times, item in self.classes:
            at, found = winnow(own.h, own.rows, length)
            at = own.around(at[_sorted_in(grams, found) >= 0], length)
            if not len(at):
                continue
            mine, other = own.windows(at, length)
            place = _sorted_in(h, mine)
            for _ in range(3):  # windows of one first hash are neighbours
                step = (place >= 0) & (place + 1 < len(h))
                step[step] = (h[place[step]] == mine[step]) & (g[place[step]] != other[step]) & (h[place[step] + 1] == mine[step])
                if not step.any():
                    break
                place[step] += 1
            ok = place >= 0
            ok[ok] = g[place[ok]] == other[ok]
            at, place = at[ok], place[ok]
            pairs = np.unique(own.rows[at] * len(h) + place)
            row, window = np.divmod(pairs, len(h))
            run, i = ragged(times[window])
            yield at, length, row[run], item[first[window][run] + i]


def _covered(own: Words, found: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Which words lie in a window that was found."""
    edge = np.zeros(len(own.rows) + 1, np.int64)
    for at, length in found:
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _runs(hit: np.ndarray) -> list[int]:
    """First and last + 1 of each run of true cells, flattened."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return edge.tolist()


def _columns(n_words: list[int], spans: list[list[int]], items: list[list[str]]) -> list[pa.Array]:
    hit = [sum(x[1::2]) - sum(x[::2]) for x in spans]
    return [
        pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), pa.array(hit, pa.int64()), pa.array(map(len, items), pa.int64()),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([h > 0 and 20 * h >= w for h, w in zip(hit, n_words)], pa.bool_()),
    ]


def _step(index):
    def run(batches):
        ix = index.value
        for part, raw, offsets in blocks(batches):
            own = Words(raw, offsets)
            items: list[set] = [set() for _ in range(part.num_rows)]
            found = []
            for at, length, rows, numbers in ix.search(own):
                found.append((at, length))
                for r, k in zip(rows.tolist(), ix.names[numbers].tolist()):
                    items[r].add(k)
            spans: list[list[int]] = [[] for _ in range(part.num_rows)]
            if found:
                hit = _covered(own, found)
                for r in np.unique(own.rows[hit]).tolist():
                    spans[r] = _runs(hit[own.base[r] : own.base[r] + own.n_words[r]])
            keep = [i for i, name in enumerate(part.schema.names) if name not in NAMES]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in keep), *_columns(own.n_words.tolist(), spans, [sorted(x) for x in items])], names=[*(part.schema.names[i] for i in keep), *NAMES]
            )

    return run


def _bench_step(window: int, grams: bool):
    """Rows (item_id, text): kept k-grams, or windows with their items."""

    def run(batches):
        for part, raw, offsets in blocks(batches):
            own = Words(raw, offsets)
            if grams:
                for length, found in _item_grams(own, window):
                    h = np.unique(found)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), length), pa.int32()), pa.array(h.view(np.int64))], names=["length", "gram"])
                continue
            for length, at in _item_windows(own, window):
                h, g = own.windows(at, length)
                ids = part.column(part.schema.get_field_index("item_id")).take(pa.array(own.rows[at]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), length), pa.int32()), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), ids], names=["length", "h", "g", "item_id"])

    return run


def _bits(gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A k-gram's word of the bitmap, and its two bits there. The lowest bit of a k-gram is 1."""
    word = ((gram >> U(32)) * U(n) >> U(32)).astype(np.int64)
    return word, (U(1) << (gram >> U(2) & U(63))) | (U(1) << (gram >> U(8) & U(63)))


def _candidate_step(bitmap, lengths: list[int]):
    """Every row with a number and its words; and the windows around its hits."""

    def run(batches):
        bits, number = bitmap.value, TaskContext.get().partitionId() << 40
        for part, raw, offsets in blocks(batches):
            own, n = Words(raw, offsets), part.num_rows
            keys = number + np.arange(n)
            number += n
            keep = [i for i, name in enumerate(part.schema.names) if name not in NAMES]
            names = [*(part.schema.names[i] for i in keep), "_key", "n_words", "_length", "_at", "_h", "_g"]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(keys), pa.array(own.n_words), *(pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=names)
            for length in lengths:
                at, found = winnow(own.h, own.rows, length)
                word, mask = _bits(found, len(bits))
                at = own.around(at[bits[word] & mask == mask], length)
                if len(at):
                    h, g = own.windows(at, length)
                    row = own.rows[at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.nulls(len(at), part.column(i).type) for i in keep), pa.array(keys[row]), pa.nulls(len(at), pa.int64()),
                            pa.array(np.full(len(at), length), pa.int32()), pa.array(at - own.base[row]), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)),
                        ],
                        names=names,
                    )

    return run


def _finish_step(batches):
    """Rows with the windows and items found in them, to the added columns."""
    for part in batches:
        get = lambda x: part.column(part.schema.get_field_index(x))
        keep = [x for x in part.schema.names if x not in ("n_words", "_found", "_items")]
        n_words, spans = get("n_words").to_pylist(), []
        for n, found in zip(n_words, get("_found")):
            hit = np.zeros(n + 1, np.int64)
            if found.is_valid:
                at, length = (np.asarray(x) for x in found.values.flatten())
                np.add.at(hit, at, 1)
                np.add.at(hit, at + length, -1)
            spans.append(_runs(np.cumsum(hit[:-1]) > 0))
        yield pa.RecordBatch.from_arrays([*(get(x) for x in keep), *_columns(n_words, spans, [sorted(x or ()) for x in get("_items").to_pylist()])], names=[*keep, *NAMES])


def _joined(documents: DataFrame, bench: DataFrame, window: int, filter_words: int) -> DataFrame:
    """A benchmark of any size, by a join of windows."""
    spark, columns = documents.sparkSession, documents.columns
    out = documents.select(F.struct(F.lit(0).alias("_"), *(c for c in columns if c != "text")).alias("row"), "text")  # no names that clash
    grams = bench.mapInArrow(_bench_step(window, True), "length int, gram bigint").distinct()
    grams = cut(grams, "grams")
    lengths = sorted(r["length"] for r in grams.select("length").distinct().collect())  # `window` rows at most
    gram = F.col("gram")
    word = F.shiftrightunsigned(F.shiftrightunsigned(gram, 32) * filter_words, 32)
    bit = lambda k: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {k}) & 63 as int))")
    set_ = grams.groupBy(word.alias("word")).agg(F.bit_or(bit(2).bitwiseOR(bit(8))).alias("mask")).toArrow()  # filter_words rows at most
    bitmap = np.zeros(filter_words, U)
    bitmap[set_["word"].to_numpy()] = set_["mask"].to_numpy().view(U)
    windows = cut(bench.mapInArrow(_bench_step(window, False), "length int, h bigint, g bigint, item_id string").distinct(), "windows")
    nullable = [T.StructField(f.name, f.dataType) for f in out.schema.fields]  # rows of windows have none
    more = T._parse_datatype_string("_key bigint, n_words bigint, _length int, _at bigint, _h bigint, _g bigint").fields
    found = cut(out.mapInArrow(_candidate_step(spark.sparkContext.broadcast(bitmap), lengths), T.StructType([*nullable, *more])), "candidates")
    near = found.where("_h is not null").select("_key", F.col("_at").alias("at"), F.col("_length").alias("length"), F.col("_h").alias("h"), F.col("_g").alias("g"))
    known = near.join(windows.select("length", "h", "g").distinct(), ["length", "h", "g"], "left_semi")
    known = cut(known, "known")
    places = known.groupBy("_key").agg(F.collect_list(F.struct("at", F.col("length").cast("bigint"))).alias("_found"))  # of one document
    items = known.select("_key", "length", "h", "g").distinct().join(windows, ["length", "h", "g"]).groupBy("_key").agg(F.collect_set("item_id").alias("_items"))
    rows = found.where("_h is null").select(*out.columns, "_key", "n_words").join(places, "_key", "left").join(items, "_key", "left").drop("_key")
    done = rows.mapInArrow(_finish_step, T.StructType([*nullable, *T._parse_datatype_string(ADDED).fields]))
    return done.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns), *NAMES)


def find_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, filter_words: int = FILTER_WORDS) -> DataFrame:
    """`documents` (text and any other columns) with n_words, hit_spans (first word and last
    word + 1 of each run of hit words, flattened), hit_items (item ids as sorted strings),
    n_hit, n_items, items_sha256 and contaminated (a twentieth of the words or more is hit)."""
    spark = documents.sparkSession
    arrow_limits(spark)
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    out = documents.drop(*NAMES)
    if total > block_bytes:
        return _joined(out, bench, window, filter_words)
    schema = T.StructType([*out.schema.fields, *T._parse_datatype_string(ADDED).fields])
    index = Index([(r["item_id"], r["text"]) for r in bench.collect()], window)  # of at most `block_bytes` of text
    return out.mapInArrow(_step(spark.sparkContext.broadcast(index)), schema)


def judge(hits: DataFrame) -> DataFrame:
    """What `find_hits` gives, without the spans and the items themselves."""
    return hits.drop("hit_spans", "hit_items")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `documents` that are not contaminated, with their own columns."""
    columns = documents.columns
    rows = documents.select(F.struct(*(c for c in columns if c != "text")).alias("row"), "text")
    clean = judge(find_hits(rows, benchmark, window, block_bytes)).where("not contaminated")
    return clean.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = judge(find_hits(docs, table(spark, sf_dir, "benchmark")))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: Every window of either side as text; joined as they stand.
OP1_SQL = r"""
with d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents
), b as (
  select item_id, w, least(13, len(w)) as n from (
    select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark)
  where len(w) > 0
), bw as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from (select *, unnest(range(1, len(w) - n + 2)) as i from b)
), dw as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (
    select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from b) where len(w) >= n)
), hit as (
  select doc_id, n, i, item_id from dw join bw using (n, g)
), places as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by 1
), found as (
  select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as ids from hit group by 1
)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join places p on p.doc_id = d.doc_id left join found f on f.doc_id = d.doc_id
"""
