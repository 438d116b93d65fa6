"""Language-model scores from Brown class-based n-grams.

Words are put into `CLASSES` classes by exchange: a word moves to the class that raises the
likelihood of the class bigrams most. It is done in two steps. The `HEAD` most frequent words,
and `SHAPES` units that all others share by their last letters and punctuation, are exchanged
one by one on a table of bigram counts, until a sweep moves nothing. Then every word of the
`DICTIONARY` most frequent gets a class from its own contexts: its counts by class before and
class after are gathered over the corpus, spread by word, and each word moves to its best class
given all others; `ROUNDS` of this, as long as the likelihood rises. Words beyond the dictionary,
the rare and the unknown, stay in the classes of their shapes. A token's probability is

    P(class | class before) * P(unit | class) * P(word | unit)

each smoothed, the last 1 for a word of the dictionary and, in a shape unit, the word's own
count against the unit's, with room for one unknown word: the probabilities of what may follow
sum to one.

Texts are split into words twice, to count them and to write them as unit numbers; all later
passes read the numbers. A word's count is needed for its score. The dictionary, of words of at
most `WORD_BYTES` bytes, is broadcast; tokens of the rest are counted per document and joined to
the counts by word, so nothing that grows with the vocabulary is gathered in one place.

Defined results: a null text is empty and has just the end token. Without training texts every
probability is that of the smoothing alone. Every row has its own score, repeated or without
an id (which counts as training: crc32 of null is null). A text of any length is scored whole.
Columns of the input but doc_id and text are not read, so that their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import arrow_limits, cut, table
from ._text import NOT_SPACE, U, blocks, lower, mix, ragged, span_hashes, words

HEAD = 1024
SUFFIXES = 128
SHAPES = 3 * SUFFIXES
CLASSES = 64
DICTIONARY = 1 << 17
WORD_BYTES = 64
SWEEPS = 12
ROUNDS = 3
SMOOTH = 0.1
BACKOFF = 5.0
COARSE = 1 + HEAD + SHAPES  # units of the first step; unit 0 is the end of a text
#: Contexts that are weighed, and tokens that are read, at once.
AT_ONCE = 1 << 13
TOKENS = 1 << 20

_STOP = np.zeros(256, np.int64)
for _b, _k in [*((b, 1) for b in b".!?"), *((b, 2) for b in b",;:")]:
    _STOP[_b] = _k


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def shapes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The shape unit, from 0, of each word: its last two bytes before a stop, and the stop."""
    stop = np.where(ends - starts > 1, _STOP[buf[ends - 1]], 0)
    last = ends - (stop > 0) - 1
    one = buf[last].astype(np.int64)
    two = np.where(last > starts, buf[np.maximum(last - 1, 0)], 0).astype(np.int64)
    return ((one * 31 + two * 97 + (one * two >> 3)) % SUFFIXES) * 3 + stop


def _word_array(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    run, k = ragged(sizes)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf[starts[run] + k])]).cast(pa.string())


def _count_step(batches):
    for part, raw, offsets in blocks(batches):
        buf = lower(raw)
        starts, ends, _ = words(buf, offsets, NOT_SPACE)
        if len(starts):
            _, first, n = np.unique(span_hashes(buf, starts, ends), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([_word_array(buf, starts[first], ends[first]), pa.array(n, pa.int64())], names=["word", "c"])


def word_counts(texts: DataFrame) -> DataFrame:
    """word, c over all texts; the end tokens are not among them."""
    arrow_limits(texts.sparkSession)
    return texts.select("text").mapInArrow(_count_step, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Dictionary:
    """The most frequent words, with their counts. Unit 0 is the end of a text, then come the
    words by falling frequency, then the shapes of all other words."""

    def __init__(self, rows: list[tuple[str, int]], head: int = HEAD) -> None:
        data = [w.encode() for w, _ in rows]
        ends = np.cumsum([len(d) for d in data]).astype(np.int64) if data else np.zeros(0, np.int64)
        starts = ends - np.array([len(d) for d in data], np.int64)
        buf = np.frombuffer(b"".join(data), np.uint8)
        h, g = span_hashes(buf, starts, ends), span_hashes(buf, starts, ends, 1)
        order = np.argsort(h)
        self.h, self.g = h[order], g[order]
        self.unit = order.astype(np.int32) + 1
        self.first_shape = len(rows) + 1
        self.units = self.first_shape + SHAPES
        self.counts = np.array([0, *(c for _, c in rows)], np.int64)  # by unit
        own = np.arange(len(rows)) + 1
        shape = shapes(buf, starts, ends) + 1 + head if rows else own
        self.coarse = np.concatenate([[0], np.where(own <= head, own, shape), np.arange(SHAPES) + 1 + head]).astype(np.int64)

    def look_up(self, buf, starts, ends) -> np.ndarray:
        """Each word's unit."""
        if not len(starts):
            return np.zeros(0, np.int32)
        out = (shapes(buf, starts, ends) + self.first_shape).astype(np.int32)
        if len(self.h):
            h = span_hashes(buf, starts, ends)
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            hit = np.flatnonzero(self.h[at] == h)
            hit = hit[self.g[at[hit]] == span_hashes(buf, starts[hit], ends[hit], 1)]
            out[hit] = self.unit[at[hit]]
        return out


def _with_ends(units: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Units before and at each token, the ends of the rows included; tokens in row order."""
    counts = np.bincount(rows, minlength=n_rows)
    at = np.cumsum(counts + 1) - 1  # places of the ends
    seq = np.zeros(len(units) + n_rows, np.int64)
    inner = np.ones(len(seq), bool)
    inner[at] = False
    seq[inner] = units
    return np.concatenate([[0], seq[:-1]]), seq


def _sequences(batches):
    """Units before and at each token of rows with `TOKENS` words at most, or of one row, the
    ends included."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("units"))
        upto = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
        a = 0
        while a < batch.num_rows:
            z = max(a + 1, int(np.searchsorted(upto, upto[a] + TOKENS, "right")) - 1)
            part = batch.slice(a, z - a)
            sizes = np.diff(upto[a : z + 1])
            rows = np.repeat(np.arange(z - a), sizes)
            before, now = _with_ends(part.column(part.schema.get_field_index("units")).flatten().to_numpy(), rows, z - a)
            yield part, sizes, before, now
            a = z


def _pair_step(group_of, size: int):
    """Counts of pairs of groups: group_of has each unit's."""

    def run(batches):
        total, group = np.zeros(size * size, np.int64), group_of.value
        for _, _, before, now in _sequences(batches):
            total += np.bincount(group[before] * size + group[now], minlength=size * size)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells])], names=["cell", "n"])

    return run


def pair_counts(tokens: DataFrame, group_of: np.ndarray, size: int) -> np.ndarray:
    """Counts of pairs of groups of units over all texts: size x size cells at most reach the driver."""
    shared = tokens.sparkSession.sparkContext.broadcast(np.asarray(group_of, np.int64))
    found = tokens.select("units").mapInArrow(_pair_step(shared, size), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def pair_likelihood(m: np.ndarray) -> float:
    """The part of the class-bigram log-likelihood that depends on the classes."""
    m = m.astype(float)
    return float(_xlogx(m).sum() - _xlogx(m.sum(1)).sum() - _xlogx(m.sum(0)).sum())


def likelihood(bigrams: np.ndarray, of: np.ndarray, classes: int) -> float:
    m = np.zeros((classes, classes))
    np.add.at(m, (of[:, None], of[None, :]), bigrams)
    return pair_likelihood(m)


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit. The end has class 0 to itself; units start in the classes of
    their rank by frequency, and each moves while that raises the likelihood."""
    b = bigrams.astype(np.float64)
    n = b.sum(0) + b.sum(1)
    order = 1 + np.argsort(-n[1:], kind="stable")
    of = np.zeros(len(b), np.int64)
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    one = np.eye(classes)[of]
    right, left = b @ one, b.T @ one  # of each unit: counts to and from classes
    m = one.T @ right
    for _ in range(sweeps):
        moved = 0
        for u in order[n[order] > 0]:
            a, own = of[u], b[u, u]
            r, q = right[u].copy(), left[u].copy()
            r[a] -= own
            q[a] -= own
            m[a] -= r
            m[:, a] -= q
            m[a, a] -= own
            rows, cols = m.sum(1), m.sum(0)
            f = _xlogx(m)
            grow = (_xlogx(m + r) - f).sum(1) + (_xlogx(m + q[:, None]) - f).sum(0)
            d = np.arange(classes)
            base = m[d, d]
            grow += _xlogx(base + r + q + own) + _xlogx(base) - _xlogx(base + r) - _xlogx(base + q)
            grow -= _xlogx(rows + r.sum() + own) - _xlogx(rows) + _xlogx(cols + q.sum() + own) - _xlogx(cols)
            grow[0] = -np.inf
            best = int(np.argmax(grow))
            if grow[best] <= grow[a] + 1e-9:
                best = a
            m[best] += r
            m[:, best] += q
            m[best, best] += own
            if best != a:
                of[u] = best
                moved += 1
                right[:, a] -= b[:, u]
                right[:, best] += b[:, u]
                left[:, a] -= b[u]
                left[:, best] += b[u]
        if not moved:
            break
    return of


def _context_step(class_of, classes: int):
    """For each unit its tokens by class after, from cell 0, and by class before, from cell
    `classes`: cells as cell + 2 * classes * tokens."""

    def run(batches):
        of, wide = class_of.value, 2 * classes
        for _, _, before, now in _sequences(batches):
            keys, n = np.unique(np.concatenate([before * wide + of[now], now * wide + classes + of[before]]), return_counts=True)
            unit, cell = np.divmod(keys, wide)
            first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else unit
            at = pa.array(np.append(first, len(unit)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(unit[first], pa.int32()), pa.ListArray.from_arrays(at, pa.array(cell + wide * n, pa.int64()))], names=["unit", "cells"])

    return run


def best_classes(unit: np.ndarray, cell: np.ndarray, n: np.ndarray, class_of: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units that some other class suits better, and that class. unit, cell, n: contexts
    sorted by unit; m: counts of class pairs. What a unit adds to its own class is taken out of
    it first; class 0, the end's, takes no other."""
    classes = len(m)
    units, first = np.unique(unit, return_index=True)
    own = class_of[units]
    gain = np.zeros((len(units), classes))
    rows, cols = m.sum(1).astype(float), m.sum(0).astype(float)
    for a in range(0, len(unit), AT_ONCE):
        b = slice(a, a + AT_ONCE)
        after = cell[b] < classes
        x = np.where(after[:, None], m.T[cell[b] % classes], m[cell[b] % classes]).astype(float)
        k = np.searchsorted(units, unit[b])
        i = np.arange(len(k))
        x[i, own[k]] = np.maximum(x[i, own[k]] - n[b], 0)
        np.add.at(gain, k, _xlogx(x + n[b][:, None]) - _xlogx(x))
    after = cell < classes
    for margin, side in ((rows, after), (cols, ~after)):
        size = np.add.reduceat(np.where(side, n, 0), first).astype(float)
        x = np.repeat(margin[None, :], len(units), axis=0)
        i = np.arange(len(units))
        x[i, own] = np.maximum(x[i, own] - size, 0)
        gain -= _xlogx(x + size[:, None]) - _xlogx(x)
    gain[:, 0] = -np.inf
    best = gain.argmax(axis=1)
    better = (gain[np.arange(len(units)), best] > gain[np.arange(len(units)), own] + 1e-9) & (units > 0)
    return units[better], best[better]


def _move_step(class_of, m):
    """Rows (unit, cells) sorted by unit: the units that move, and where to."""

    def moves(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        sizes = pc.list_value_length(rows["cells"]).to_numpy()
        unit = np.repeat(rows["unit"].to_numpy(), sizes).astype(np.int64)
        wide = 2 * len(m.value)
        times, cell = np.divmod(pc.list_flatten(rows["cells"]).to_numpy(), wide)
        keys, inverse = np.unique(unit * wide + cell, return_inverse=True)
        n = np.bincount(inverse, weights=times)
        units, to = best_classes(*np.divmod(keys, wide), n, class_of.value, m.value)
        return pa.RecordBatch.from_arrays([pa.array(units, pa.int32()), pa.array(to, pa.int32())], names=["unit", "to"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            unit = b.column(0).to_numpy()
            last = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on in the next batch
            if last or (held and held[-1].column(0)[-1].as_py() != unit[0]):
                ready = [*held, b.slice(0, last)] if last else held
                yield moves(ready)
                held = []
            held.append(b.slice(last))
        if held:
            yield moves(held)

    return run


def refine(tokens: DataFrame, class_of: np.ndarray, m: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Exchange of all units by their own contexts, spread by unit: the classes, and their pair
    counts. Units move together, half of them in each of the first rounds, so a round counts
    only if the likelihood has risen."""
    sc, classes = tokens.sparkSession.sparkContext, len(m)
    for k in range(rounds):
        of, pairs = sc.broadcast(class_of), sc.broadcast(m)
        contexts = tokens.select("units").mapInArrow(_context_step(of, classes), "unit int, cells array<bigint>")
        moved = contexts.repartition("unit").sortWithinPartitions("unit").mapInArrow(_move_step(of, pairs), "unit int, to int").toArrow()  # a row a unit at most
        unit, to = moved["unit"].to_numpy(), moved["to"].to_numpy()
        some = mix(unit.astype(U)) % U(2) == U(k % 2) if k < 2 else np.ones(len(unit), bool)
        if not some.any():
            continue
        new = class_of.copy()
        new[unit[some]] = to[some]
        found = pair_counts(tokens, new, classes)
        if pair_likelihood(found) <= pair_likelihood(m):
            break
        class_of, m = new, found
    return class_of, m


@dataclass
class Model:
    dictionary: Dictionary
    class_of: np.ndarray  # by unit
    change: np.ndarray  # log10 of P(class | class before)
    emit: np.ndarray  # log10 of P(unit | class), by unit
    unit_total: np.ndarray  # of shapes: their words' tokens, and room for smoothing
    base_total: float
    train_tokens: int
    end_count: int


def class_logs(m: np.ndarray, seen: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 P(class | class before), and log10 P(unit | class) of every unit."""
    members = np.bincount(of, minlength=len(m))
    of_class = np.bincount(of, weights=seen, minlength=len(m))
    prior = (of_class + SMOOTH * members) / (of_class + SMOOTH * members).sum()
    change = (m + BACKOFF * prior) / (m.sum(1, keepdims=True) + BACKOFF)
    with np.errstate(divide="ignore"):  # classes without members are never asked for
        return np.log10(change), np.log10((seen + SMOOTH) / (of_class + SMOOTH * members)[of])


def _token_step(dictionary):
    """Rows as their words' units, and the words that are not in the dictionary, counted."""

    def run(batches):
        own = dictionary.value
        number = TaskContext.get().partitionId() << 40
        names = ["row", "doc_id", "units", "word", "unit", "n"]
        for part, raw, offsets in blocks(batches):
            n = part.num_rows
            buf = lower(raw)
            starts, ends, rows = words(buf, offsets, NOT_SPACE)
            units = own.look_up(buf, starts, ends)
            counts = np.bincount(rows, minlength=n)
            keys = number + np.arange(n)
            number += n
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(units))
            yield pa.RecordBatch.from_arrays([pa.array(keys), part.column(0), lists, pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=names)
            rest = np.flatnonzero(units >= own.first_shape)
            if len(rest):
                h = span_hashes(buf, starts[rest], ends[rest])
                order = np.lexsort((h, rows[rest]))
                s = rest[order]
                fresh = np.flatnonzero(np.r_[True, (rows[s][1:] != rows[s][:-1]) | (h[order][1:] != h[order][:-1])])
                first, times, k = s[fresh], np.diff(np.append(fresh, len(s))), len(fresh)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[rows[first]]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int32())), _word_array(buf, starts[first], ends[first]), pa.array(units[first]), pa.array(times, pa.int64())], names=names
                )

    return run


@dataclass
class Vocabulary:
    dictionary: Dictionary
    counts: DataFrame  # word, c of every training word
    tokens: int
    distinct: int
    n_texts: int


def vocabulary(training: DataFrame) -> Vocabulary:
    counts = cut(word_counts(training), "counts")
    n_texts = training.count()
    w = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.where(F.octet_length("word") <= WORD_BYTES).orderBy(F.desc("c"), "word").limit(DICTIONARY).toArrow()  # DICTIONARY x WORD_BYTES bytes at most
    return Vocabulary(Dictionary(list(zip(top["word"].to_pylist(), top["c"].to_pylist()))), counts, w["n"] + n_texts, w["v"] + (n_texts > 0), n_texts)


def tokenize(documents: DataFrame, dictionary: Dictionary) -> DataFrame:
    """row, doc_id, units of every row; and row, word, unit, n of its words beyond the dictionary."""
    arrow_limits(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(dictionary)
    return cut(documents.select("doc_id", "text").mapInArrow(_token_step(shared), "row bigint, doc_id bigint, units array<int>, word string, unit int, n bigint"), "tokens")


def _shape_step(dictionary):
    """Words and tokens of each shape among the counts of words that are not in the dictionary."""

    def run(batches):
        own = dictionary.value
        words_of, tokens = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
        for part, raw, offsets in blocks(batches, "word"):
            shape = own.look_up(raw, offsets[:-1], offsets[1:]) - own.first_shape
            rest = shape >= 0
            words_of += np.bincount(shape[rest], minlength=SHAPES)
            tokens += np.bincount(shape[rest], weights=part.column(1).to_numpy()[rest], minlength=SHAPES).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPES), pa.int32()), pa.array(words_of), pa.array(tokens)], names=["shape", "words", "tokens"])

    return run


def fit_classes(tokens: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Model:
    """The model of training texts that are written as units."""
    own = vocab.dictionary
    spark = tokens.sparkSession
    texts = tokens.where("units is not null")
    coarse = exchange(pair_counts(texts, own.coarse, COARSE))
    class_of = coarse[own.coarse].astype(np.int64)
    class_of, m = refine(texts, class_of, pair_counts(texts, class_of, CLASSES), rounds)
    found = vocab.counts.select("word", "c").mapInArrow(_shape_step(spark.sparkContext.broadcast(own)), "shape int, words bigint, tokens bigint")
    total, seen = np.full(SHAPES, SMOOTH), np.concatenate([own.counts, np.zeros(SHAPES, np.int64)])
    seen[0] = vocab.n_texts
    for r in found.groupBy("shape").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).collect():  # SHAPES rows
        seen[own.first_shape + r["shape"]] = r["tokens"]
        total[r["shape"]] = r["tokens"] + SMOOTH * (r["words"] + 1)
    change, emit = class_logs(m, seen, class_of)
    return Model(own, class_of, change, emit, total, vocab.tokens + SMOOTH * (vocab.distinct + 1), vocab.tokens, vocab.n_texts)


def _score_step(model_of):
    def run(batches):
        m = model_of.value
        base_log = lambda c: np.log10((c + SMOOTH) / m.base_total)
        base_of = np.append(base_log(m.dictionary.counts), np.zeros(SHAPES))  # words beyond are joined to their counts
        base_of[0] = base_log(m.end_count)
        known_of = np.append(m.dictionary.counts > 0, np.zeros(SHAPES, bool)).astype(np.int64)
        known_of[0] = m.end_count > 0
        for part, sizes, before, now in _sequences(batches):
            n = part.num_rows
            row = np.repeat(np.arange(n), sizes + 1)
            total = lambda x: np.bincount(row, weights=x, minlength=n)
            score = total(m.change[m.class_of[before], m.class_of[now]] + m.emit[now])
            own = [part.column(part.schema.get_field_index(x)) for x in ("row", "doc_id")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(sizes + 1, pa.int64()), pa.array(total(known_of[now]).astype(np.int64)), pa.array(total(base_of[now])), pa.array(score)],
                names=["row", "doc_id", "n_tokens", "n_known", "base", "score"],
            )

    return run


def score_tokens(tokens: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row that is written as units."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(model)
    found = tokens.where("units is not null").select("row", "doc_id", "units").mapInArrow(_score_step(shared), "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, score double")
    totals = spark.createDataFrame([(i + model.dictionary.first_shape, float(t)) for i, t in enumerate(model.unit_total)], "unit int, unit_total double")
    c = F.coalesce("c", F.lit(0))
    rest = (
        tokens.where("word is not null").select("row", "word", "unit", "n").join(counts, "word", "left").join(F.broadcast(totals), "unit")
        .groupBy("row").agg(
            F.sum(F.col("n") * F.log10((c + SMOOTH) / model.base_total)).alias("more_base"),
            F.sum(F.col("n") * F.log10((c + SMOOTH) / F.col("unit_total"))).alias("more_score"),
            F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
        )
    )
    zero = lambda x: F.coalesce(x, F.lit(0))
    return found.join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + zero("more_known")).alias("n_known"),
        (F.col("base") + zero("more_base")).alias("base_score"), (F.col("score") + zero("more_score")).alias("score"),
    )


def fit(training: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model of the training texts, and the table of their word counts."""
    vocab = vocabulary(training)
    return fit_classes(tokenize(training, vocab.dictionary), vocab, rounds), vocab.counts


def score(documents: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row."""
    return score_tokens(tokenize(documents, model.dictionary), model, counts)


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = vocabulary(docs.where(~held_out()))
    tokens = tokenize(docs, vocab.dictionary)
    model = fit_classes(tokens.where(~held_out()), vocab)
    out = score_tokens(tokens, model, vocab.counts)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
