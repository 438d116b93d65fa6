"""Byte-level BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a pre-token there is exactly one token that its encoding ends in. It is
found among the vocabulary's tokens that are suffixes of the prefix (one pass of a suffix
automaton finds them all): the token whose remainder's own last token is compatible with it.
Two tokens are compatible if undoing their merges, latest first, never uncovers a pair across
their border that would have merged earlier. Back-pointers then give the exact ids, in time
that grows with the pre-token's length, whatever its contents.

Pre-tokens are found for a whole block of texts at once from the classes of its code points.
Each distinct pre-token is encoded once and kept in a bounded store of the worker, so a
frequent word costs an array lookup.

Defined results: a null or empty text has no ids and decodes to the empty text. Added tokens
in a text become their own id, as the library does by default, or, with `special=False`,
ordinary text. Bytes that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import arrow_limits, table
from ._text import blocks, ragged, span_hashes

STORE = 200_000
LETTER, NUMBER, SPACE, OTHER, ADDED = range(5)
#: The endings that the pre-tokenizer splits off.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable and no space in Latin-1,
    else the next one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, everything):
            shift = lambda i: i + 0x800 * (i >= 0xD800)
            out[shift(m.start()) : shift(m.end() - 1) + 1] = kind
    return out


class Vocabulary:
    """The tables of a byte-level BPE tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        self.ids = data["model"]["vocab"]
        self.bytes = {i: bytes(byte[c] for c in t) for t, i in self.ids.items()}
        self.added = {x["content"].encode(): x["id"] for x in data["added_tokens"]}
        self.all_bytes = self.bytes | {i: t for t, i in self.added.items()}
        size = max(self.all_bytes) + 1
        self.rank = [-1] * size
        self.left, self.right = [0] * size, [0] * size
        self.pair: dict[int, int] = {}
        for r, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in data["model"]["merges"]):
            t, i, j = self.ids[a + b], self.ids[a], self.ids[b]
            self.pair[i << 32 | j] = r
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, i, j
        self.automaton = ahocorasick.Automaton()
        for i, t in self.bytes.items():
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}

    def compatible(self, x: int, y: int) -> bool:
        """Whether the text of tokens x and y is encoded as just these two."""
        key = x << 32 | y
        found = self.known.get(key)
        if found is None:
            if len(self.known) > STORE:
                self.known.clear()
            found = self.known[key] = self._compatible(x, y)
        return found

    def _compatible(self, x: int, y: int) -> bool:
        rank, pair = self.rank, self.pair
        before = len(self.pair)
        while True:
            r = pair.get(x << 32 | y)
            if r is not None and r < before:
                return False
            if rank[x] < 0 and rank[y] < 0:
                return True
            if rank[x] > rank[y]:  # x was made last; of equal merges the left one comes first
                before, x = rank[x], self.right[x]
            else:
                before, y = rank[y] + 1, self.left[y]

    def encode_piece(self, piece: bytes) -> list[int]:
        last, place = [0] * (len(piece) + 1), [-1] * (len(piece) + 1)
        place[0] = 0
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if place[end] < 0:
                start = end - size
                if start == 0 or (place[start] >= 0 and self.compatible(last[start], token)):
                    last[end], place[end] = token, start
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at = place[at]
        return out[::-1]


def _code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places and values of the code points of valid UTF-8."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    cp = raw[at].astype(np.int32)
    wide = np.flatnonzero(cp >= 0xC0)
    if len(wide):
        lead, p = cp[wide], at[wide]
        padded = np.concatenate([raw, np.zeros(3, np.uint8)])
        b1, b2, b3 = ((padded[p + k] & 0x3F).astype(np.int32) for k in (1, 2, 3))
        cp[wide] = np.where(lead < 0xE0, (lead & 0x1F) << 6 | b1, np.where(lead < 0xF0, (lead & 0x0F) << 12 | b1 << 6 | b2, (lead & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))
    return at, np.minimum(cp, 0x10FFFF)


def pieces(raw: np.ndarray, offsets: np.ndarray, added: tuple[bytes, ...] = ()) -> np.ndarray:
    """Byte places at which the pre-tokens of a block begin; none crosses a row."""
    edges, special = [offsets], []
    data = raw.tobytes() if added else b""
    for token in added:
        at = data.find(token)
        while at >= 0:
            row_end = offsets[np.searchsorted(offsets, at, "right")]
            if at + len(token) <= row_end:
                special.append((at, at + len(token)))
                at = data.find(token, at + len(token))
            else:
                at = data.find(token, at + 1)
    if special:
        edges.append(np.array(special, np.int64).ravel())
    at, cp = _code_points(raw)
    n = len(at)
    kind = code_point_classes()[cp]
    fresh = np.zeros(n + 1, bool)
    edge = np.concatenate(edges)
    fresh[np.searchsorted(at, edge[edge < len(raw)])] = True
    fresh[0] = fresh[n] = True
    for a, b in special:
        kind[np.searchsorted(at, a) : np.searchsorted(at, b)] = ADDED
    change = fresh.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    start = change.copy()
    # The last of some white space goes with what follows if it is a plain space, else alone.
    follows = np.flatnonzero(change[1:n] & ~fresh[1:n] & (kind[:-1] == SPACE)) + 1
    start[follows - 1] = True
    start[follows[cp[follows - 1] == 0x20]] = False
    quote = np.flatnonzero((cp == 0x27) & start[:n] & (kind == OTHER))
    follow = np.concatenate([cp, np.zeros(3, np.int32)])
    inside = lambda i: ~fresh[np.minimum(i, n)]
    for ending in ENDINGS:
        here = quote
        for k, c in enumerate(ending, 1):
            here = here[(follow[here + k] == ord(c)) & inside(here + k)]
        start[here + 1] = False
        start[here + 1 + len(ending)] = True
    return at[np.flatnonzero(start[:n])]


class Encoder:
    """Encodes blocks of texts, keeping the ids of distinct pre-tokens."""

    def __init__(self, path: str, special: bool = True) -> None:
        self.vocabulary = Vocabulary(path)
        self.added = tuple(self.vocabulary.added) if special else ()
        items = sorted(self.vocabulary.all_bytes.items())
        self.lengths = np.zeros(items[-1][0] + 1, np.int64)
        for i, t in items:
            self.lengths[i] = len(t)
        self.flat = np.frombuffer(b"".join(t for _, t in items), np.uint8)
        self.first = np.cumsum(self.lengths) - self.lengths
        self._forget()

    def _forget(self) -> None:
        self.store: dict[bytes, int] = {}
        self.kept = np.zeros(1 << 16, np.uint32)
        self.kept_first: list[int] = []
        self.kept_size: list[int] = []
        self.end = 0
        for t in self.added:
            self._add(t, [self.vocabulary.added[t]])

    def _add(self, piece: bytes, ids: list[int]) -> int:
        if self.end + len(ids) > len(self.kept):
            self.kept = np.concatenate([self.kept, np.zeros(max(len(self.kept), len(ids)), np.uint32)])
        self.kept[self.end : self.end + len(ids)] = ids
        self.kept_first.append(self.end)
        self.kept_size.append(len(ids))
        self.end += len(ids)
        self.store[piece] = len(self.store)
        return len(self.store) - 1

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block and the rows' offsets among them."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(self.store) > STORE or self.end > 20 * STORE:
            self._forget()
        starts = pieces(raw, offsets, self.added)
        ends = np.append(starts[1:], len(raw))
        h, g = span_hashes(raw, starts, ends), span_hashes(raw, starts, ends, 1)
        _, some, which = np.unique(h, return_index=True, return_inverse=True)
        same = g[some][which] == g
        if not same.all():  # two pre-tokens of one hash: take each on its own
            some, which = np.arange(len(starts)), np.arange(len(starts))
        data = raw.tobytes()
        number = np.empty(len(some), np.int64)
        get = self.store.get
        for k, (s, e) in enumerate(zip(starts[some].tolist(), ends[some].tolist())):
            piece = data[s:e]
            i = get(piece)
            number[k] = self._add(piece, self.vocabulary.encode_piece(piece)) if i is None else i
        number = number[which]
        first, size = np.array(self.kept_first), np.array(self.kept_size)
        run, k = ragged(size[number])
        ids = self.kept[first[number][run] + k]
        upto = np.concatenate([[0], np.cumsum(size[number])])
        return ids, upto[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids' bytes laid end to end, and each id's end among them."""
        run, k = ragged(self.lengths[ids])
        return self.flat[self.first[ids][run] + k], np.cumsum(self.lengths[ids])


@lru_cache(2)
def encoder(path: str, special: bool = True) -> Encoder:
    return Encoder(path, special)


def _step(path: str, special: bool, texts: bool):
    def run(batches):
        own = encoder(path, special)
        for part, raw, offsets in blocks(batches):
            ids, at = own.encode(raw, offsets)
            data, ends = own.decode(ids)
            ends = np.concatenate([[0], ends])[at]
            packed = ids.astype("<u4")
            decoded = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
            columns = [pa.array(np.diff(at), pa.int64())]
            if texts:
                columns += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(packed.view(np.int32))), pa.array(decoded, pa.string())]
            else:
                columns += [
                    pa.array([hashlib.sha256(packed[a:b].tobytes()).hexdigest() for a, b in zip(at, at[1:])]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
                ]
            names = ["n_tokens", *(("ids", "decoded") if texts else ("ids_sha256", "decoded_sha256"))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *names])

    return run


def encode_documents(documents: DataFrame, path: str, special: bool = True, texts: bool = True) -> DataFrame:
    """doc_id, n_tokens, and ids and decoded text, or with texts=False their digests. `path`
    is a tokenizer file that every executor has."""
    arrow_limits(documents.sparkSession)
    out = "ids array<int>, decoded string" if texts else "ids_sha256 string, decoded_sha256 string"
    return documents.select("doc_id", F.col("text")).mapInArrow(_step(path, special, texts), f"doc_id bigint, n_tokens bigint, {out}")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path(), texts=False)
