import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from voltlake.llm.bpe import Encoder, encode_documents, vocabulary_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def texts(n=1500):
    r = random.Random(7)
    odd = ["'", "'s", "'ll", "'re", "'RE", "'d", "'x", " ", "  ", "\n", "\t", " ", "　", "\r\n", "\x1c", "\x85", "é", "ß", "日本", "٣", "²", "½", "_", "<|endoftext|>", "<|endoftext", "|>", "😀", "é", "1", "23", "...", "!?", "‍", "\u0000", "don", "The", "tion", "ing", "aaaa", "AbC", "\U0001F468‍\U0001F469", "￿", "\U0010ffff", "͸"]
    out = [None, "", " ", "'", "<|endoftext|>", "<|endoftext|><|endoftext|>", " <|endoftext|> ", "a" * 3000, "ab" * 700, " " * 500, "1" * 333, "'s's've'"]
    for _ in range(n):
        out.append("".join(r.choice(odd) for _ in range(r.randrange(1, 14))))
    for _ in range(300):
        out.append("".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 700), r.randrange(0x300, 0xD7FF), r.randrange(0xE000, 0x1FFFF)])) for _ in range(r.randrange(1, 40))))
    return out


def test_equals_library(library):
    own = Encoder(vocabulary_path())
    ts = [t or "" for t in texts()]
    data = [t.encode() for t in ts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    ids, at = own.encode(np.frombuffer(b"".join(data), np.uint8), offsets)
    want = library.encode_batch(ts, add_special_tokens=False)
    for i, w in enumerate(want):
        assert ids[at[i] : at[i + 1]].tolist() == w.ids, ts[i]
    back, ends = own.decode(ids)
    assert back.tobytes() == b"".join(data) and ends[-1] == len(back)


def test_every_code_point(library):
    own = Encoder(vocabulary_path())
    r = random.Random(1)
    chars = [chr(c) for c in range(0x3500) if not 0xD800 <= c < 0xE000] + [chr(c) for c in r.sample(range(0x3500, 0xD800), 1500)] + [chr(c) for c in range(0xF900, 0x12500)]
    ts = ["a" + c + "1" + c + ". " + c + " x" for c in chars]
    data = [t.encode() for t in ts]
    ids, at = own.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    wrong = [hex(ord(c)) for i, (c, w) in enumerate(zip(chars, library.encode_batch(ts, add_special_tokens=False))) if ids[at[i] : at[i + 1]].tolist() != w.ids]
    assert not wrong, wrong


def test_documents(spark, docs, library):
    ts = texts(150)
    d = docs(ts).selectExpr("*", "3 as n_tokens", "'x' as ids")
    rows = {r.doc_id: r for r in encode_documents(d, vocabulary_path(), texts=False).collect()}
    for i, t in enumerate(ts):
        e = library.encode(t or "", add_special_tokens=False)
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest())
        assert rows[i].decoded_sha256 == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    full = {r.doc_id: r for r in encode_documents(d, vocabulary_path()).collect()}
    assert all(full[i].decoded == (t or "") for i, t in enumerate(ts))
    assert encode_documents(docs([]), vocabulary_path()).count() == 0
    plain = encode_documents(docs(["<|endoftext|>"]), vocabulary_path(), special=False).first()
    assert plain.n_tokens > 1 and plain.decoded == "<|endoftext|>"
