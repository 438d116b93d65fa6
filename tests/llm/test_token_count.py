import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from voltlake.llm.bpe import vocabulary_path
from voltlake.llm.token_count import as_ids, count_documents, count_tokens, read_token_files

EOD = 9


def brute(ids):
    out, n, start = [], 0, 0
    for i, t in enumerate(ids):
        if t == EOD:
            out.append((len(out), n, start, True))
            n, start = 0, i + 1
        else:
            n += 1
    return out + ([(len(out), n, start, False)] if n else [])


def test_flat_files(spark, tmp_path):
    r = random.Random(2)
    files = [[], [EOD], [1], [EOD] * 5, [1] * 100 + [EOD] + [2] * 57, [3] * 64, [1] * 63 + [EOD] + [1] * 64 + [EOD]]
    files += [[r.choice([1, 2, EOD] if k % 2 else [1] * 40 + [EOD]) for _ in range(r.randrange(400))] for k in range(12)]
    want = {}
    for k, ids in enumerate(files):
        np.array(ids, "<u2").tofile(tmp_path / f"f{k:02}.bin")
        want[f"f{k:02}"] = brute(ids)
    got = {k: [] for k in want}
    for x in count_tokens(read_token_files(spark, str(tmp_path), block_tokens=16), EOD).collect():
        got[x.file[-7:-4]].append((x.ordinal, x.n_tokens, x.token_offset, x.ended))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_spans_of_blocks(spark, monkeypatch):
    monkeypatch.setattr("voltlake.llm.token_count.SPAN", 3)
    r = random.Random(4)
    ids = [r.choice([1] * 60 + [EOD]) for _ in range(900)]
    rows = [("x", i, bytes(np.array(ids[i * 10 : i * 10 + 10], "<u2").tobytes())) for i in range(90)] + [("x", 90, None), ("x", 91, b"")]
    df = spark.createDataFrame(rows, "file string, block bigint, data binary").selectExpr("*", "1 as lengths", "2 as tail", "3 as tokens")
    assert sorted(tuple(x)[1:] for x in count_tokens(df, EOD).collect()) == brute(ids)


def test_documents(spark, docs):
    lib = Tokenizer.from_file(vocabulary_path())
    lib.encode_special_tokens = True
    texts = [None, "", "a", "The <|endoftext|> of", "word " * 900, "é日 x", ""] + [f"text {i} " * (i % 9) for i in range(80)]
    rows = count_documents(docs(texts).selectExpr("*", "1 as file", "2 as n_tokens"), vocabulary_path(), 50256, block_tokens=32).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert len(rows) == len(texts)
    assert count_documents(docs([]), vocabulary_path(), 50256).count() == 0


def test_a_block_of_empty_documents(spark):
    data = np.full(1 << 16, EOD, "<u2").tobytes()
    out = count_tokens(spark.createDataFrame([("x", 0, data), ("x", 1, data)], "file string, block bigint, data binary"), EOD)
    r = out.selectExpr("count(*) n", "count(distinct ordinal) o", "max(n_tokens) m", "sum(abs(ordinal - token_offset)) d", "min(ended) e").first()
    assert tuple(r) == (1 << 17, 1 << 17, 0, 0, True)


def test_a_file_over_two_gigabytes(spark, tmp_path):
    n = 1_200_000_000  # ids of two bytes, nearly all in a hole of the file
    ends = [5, 600_000_000, n - 3]
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(2 * n)
        for e in ends:
            f.seek(2 * e)
            f.write(np.array([EOD], "<u2").tobytes())
    got = count_tokens(read_token_files(spark, str(tmp_path), block_tokens=1 << 22), EOD).collect()
    assert sorted(tuple(r)[1:] for r in got) == [(0, 5, 0, True), (1, ends[1] - 6, 6, True), (2, n - 4 - ends[1], ends[1] + 1, True), (3, 2, n - 2, False)]


def test_ids_that_do_not_fit(spark, tmp_path):
    assert as_ids(np.array([65535]), "<u2").tolist() == [65535]
    with pytest.raises(ValueError):
        as_ids(np.array([65536]), "<u2")
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole number"):
        read_token_files(spark, str(tmp_path)).collect()


def test_long_texts_repeats_and_null_ids(spark):
    lib = Tokenizer.from_file(vocabulary_path())
    long = "many words in one text, " * 60_000
    rows = [(1, long), (1, long), (None, "a b"), (None, "a b"), (2, None), (3, "")]
    got = count_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), vocabulary_path(), 50256).collect()
    n = len(lib.encode(long, add_special_tokens=False).ids)
    assert sorted(((r.doc_id or 0), r.n_tokens) for r in got) == [(0, 2), (0, 2), (1, n), (1, n), (2, 0), (3, 0)]
    assert len({(r.file, r.ordinal) for r in got}) == len(rows)
