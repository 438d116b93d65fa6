"""Token counts by a separator scan of flat, unindexed token files.

A token file holds the ids of many documents end to end, each closed by an end-of-document id,
and nothing else. It is read as blocks (file, block, data), each a range of the file's bytes, so
a file may have any size. Each block is scanned for the separator in one vectorised comparison,
which gives the lengths between the separators in it, the first counted from the block's start,
where each begins, and the tail after the last. A prefix scan over the blocks then gives each
block the number of documents before it and the tokens carried in from blocks since the last
separator. The scan has two levels, so that the blocks of one huge file are spread over many
tasks.

Defined results: a document of no tokens counts 0. Tokens after a file's last separator are a
last document with ended = false. An empty file has no documents. Blocks may have any length,
0 too, but hold whole ids; null data counts as empty. A file that is no whole number of ids is
an error, as is an id that the type has no room for. Of documents to be tokenized a null text
counts as empty, a very long one is written over many blocks, and every row has its own count,
repeated or without an id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import arrow_limits, cut, table
from ._text import blocks as text_blocks
from .bpe import encoder, vocabulary_path

BLOCK_TOKENS = 1 << 16
#: Neighbouring blocks that one task reads.
RANGE = 256
SPAN = 1024
#: What the scan adds to a block.
FOUND = ("lengths", "starts", "tail", "tokens")


def open_uri(uri: str):
    """A file for reading, by its path or uri, on whatever machine asks: local and network
    folders by their path, other schemes by Arrow's file systems."""
    if uri.startswith("file:") or ":" not in uri.split("/")[0]:
        return open("/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri, "rb")
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def _range_step(size: int, opener):
    """Rows (file, block, length), each with its range of the file."""

    def run(batches):
        name, f = None, None
        try:
            for b in batches:
                for at in range(0, b.num_rows, 64):  # a few blocks in memory at a time
                    part, data = b.slice(at, 64), []
                    for uri, block, length in zip(*(part.column(i).to_pylist() for i in range(3))):
                        if uri != name:
                            if f is not None:
                                f.close()
                            name, f = uri, opener(uri)
                        f.seek(block * size)
                        want = min(size, length - block * size)
                        data.append(f.read(want))
                        if len(data[-1]) != want:
                            raise OSError(f"{uri} ends before its length of {length}")
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(data, pa.binary())], names=["file", "block", "data"])
        finally:
            if f is not None:
                f.close()

    return run


def read_token_files(spark: SparkSession, path: str, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS, opener=open_uri) -> DataFrame:
    """Blocks of every file under a path. `file` is the file's path. Spark lists the files and
    their lengths; tasks read ranges of them with `opener`, a function of the uri."""
    arrow_limits(spark)
    item = np.dtype(dtype).itemsize
    size = block_tokens * item
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), "length")
    whole = F.when(F.col("length") % item != 0, F.raise_error(F.concat(F.col("file"), F.lit(f" is no whole number of {item}-byte ids")))).otherwise(F.col("length"))
    blocks = files.select("file", whole.alias("length")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / size))))
    spread = F.floor(F.col("block") / RANGE)  # a task reads neighbouring blocks
    dealt = blocks.repartition("file", spread).sortWithinPartitions("file", "block").select("file", "block", "length")
    return dealt.mapInArrow(_range_step(size, opener), "file string, block bigint, data binary")


def _scan_data(data: bytes | None, eod: int, dtype: str) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Lengths and beginnings of what separators end, the tail, and the ids in all."""
    ids = np.frombuffer(data or b"", dtype)
    at = np.flatnonzero(ids == eod)
    starts = np.concatenate([[0], at[:-1] + 1]) if len(at) else at
    return at - starts, starts, len(ids) - (int(at[-1]) + 1 if len(at) else 0), len(ids)


def _scan_step(eod: int, dtype: str):
    def run(batches):
        for b in batches:
            found = [_scan_data(x.as_py(), eod, dtype) for x in b.column("data")]
            own = [x for x in b.schema.names if x != "data"]
            lists = lambda i: pa.array([f[i] for f in found], pa.list_(pa.int64()))
            whole = lambda i: pa.array([f[i] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in own), lists(0), lists(1), whole(2), whole(3)], names=[*own, *FOUND])

    return run


def scan(token_blocks: DataFrame, eod: int, dtype: str = "<u2") -> DataFrame:
    """`data` replaced by lengths, starts, tail and tokens; other columns stay."""
    arrow_limits(token_blocks.sparkSession)
    own = token_blocks.drop("data", *FOUND)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return token_blocks.drop(*FOUND).mapInArrow(_scan_step(eod, dtype), f"{fields}, lengths array<bigint>, starts array<bigint>, tail bigint, tokens bigint")


def _running(df: DataFrame, value, name: str) -> DataFrame:
    """Adds the sum of a value over a file's earlier blocks, by way of spans of blocks."""
    inside = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = df.groupBy("file", "span").agg(F.sum(value).alias("s")).select("file", "span", F.coalesce(F.sum("s").over(over), F.lit(0)).alias("s0"))
    return df.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(spans, ["file", "span"]).withColumn(name, F.col(name) + F.col("s0")).drop("s0")


def stitch(scanned: DataFrame) -> DataFrame:
    """file, ordinal, n_tokens, token_offset, ended of every document."""
    s = scanned.select("file", "block", F.floor(F.col("block") / SPAN).alias("span"), "lengths", "starts", "tail", "tokens", F.size("lengths").cast("bigint").alias("n"))
    ended = F.when(F.col("n") > 0, 1).otherwise(0).cast("bigint")
    s = _running(s, F.col("n"), "first")
    s = _running(s, ended, "closed")
    s = _running(s, F.col("tokens"), "before")
    # A block's tail goes to the document open after it: that after `closed` blocks with separators.
    carried = s.groupBy("file", (F.col("closed") + ended).alias("closed")).agg(F.sum("tail").alias("carry"), F.max(F.col("first") + F.col("n")).alias("next"), F.max(F.col("before") + F.col("tokens")).alias("upto"))
    docs = s.where("n > 0").join(carried.select("file", "closed", "carry"), ["file", "closed"], "left")
    docs = docs.select("file", "first", "before", F.coalesce("carry", F.lit(0)).alias("carry"), F.posexplode(F.arrays_zip("lengths", "starts")).alias("k", "z"))
    carry = F.when(F.col("k") == 0, F.col("carry")).otherwise(0)
    whole = docs.select(
        "file", (F.col("first") + F.col("k")).alias("ordinal"), (F.col("z.lengths") + carry).alias("n_tokens"),
        (F.col("before") + F.col("z.starts") - carry).alias("token_offset"), F.lit(True).alias("ended"),
    )
    final = carried.groupBy("file").agg(F.max(F.struct("closed", "carry", "next", "upto")).alias("z")).where("z.carry > 0")
    rest = final.select("file", F.col("z.next").alias("ordinal"), F.col("z.carry").alias("n_tokens"), (F.col("z.upto") - F.col("z.carry")).alias("token_offset"), F.lit(False).alias("ended"))
    return whole.unionByName(rest)


def count_tokens(token_blocks: DataFrame, eod: int, dtype: str = "<u2") -> DataFrame:
    """file, ordinal (from 0), n_tokens, token_offset (of the first token in the file) and
    ended of every document of the files."""
    return stitch(cut(scan(token_blocks.select("file", "block", "data"), eod, dtype), "scanned"))


def as_ids(ids: np.ndarray, dtype: str) -> np.ndarray:
    if len(ids) and int(ids.max()) > np.iinfo(dtype).max:
        raise ValueError(f"id {int(ids.max())} has no room in {dtype}")
    return ids.astype(dtype)


def _flat_step(path: str, eod: int, dtype: str, block_tokens: int):
    """A partition of documents as one flat token file, in blocks, and the ids of its documents
    in writing order: what a tokenizing job knows, without any length."""

    def rows(file, block=None, data=None, first=None, ids=None):
        return pa.RecordBatch.from_arrays(
            [pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64()))],
            names=["file", "block", "data", "first", "doc_ids"],
        )

    def run(batches):
        own, file = encoder(path, False), TaskContext.get().partitionId()
        size = block_tokens * np.dtype(dtype).itemsize
        block, ordinal, held = 0, 0, b""
        for part, raw, offsets in text_blocks(batches):
            ids, at = own.encode(raw, offsets)
            held += as_ids(np.insert(ids, at[1:], eod), dtype).tobytes()
            yield rows(file, first=ordinal, ids=part.column(0).to_pylist())
            ordinal += part.num_rows
            full = len(held) // size
            for k in range(full):
                yield rows(file, block + k, held[k * size : (k + 1) * size])
            block, held = block + full, held[full * size :]
        if held:
            yield rows(file, block, held)

    return run


def flat_files(documents: DataFrame, path: str, eod: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows (file, block, data) of flat token files, one for each partition of `documents`,
    and rows (file, first, doc_ids) that name their documents in order."""
    arrow_limits(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(_flat_step(path, eod, dtype, block_tokens), "file bigint, block bigint, data binary, first bigint, doc_ids array<bigint>")


def count_documents(documents: DataFrame, path: str, eod: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens, file, ordinal, token_offset: documents are tokenized to flat files,
    whose scan alone gives the counts; the names in writing order are then put to them."""
    scanned = cut(scan(flat_files(documents, path, eod, dtype, block_tokens), eod, dtype), "scanned")
    counts = stitch(scanned.where("block is not null"))
    names = scanned.where("block is null").select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return names.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "token_offset")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_documents(table(spark, sf_dir, "documents"), vocabulary_path(), eod=50256)
