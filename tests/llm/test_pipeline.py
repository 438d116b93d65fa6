"""The pipeline against brute-force versions of its stages, each on its own input."""

import random

from test_decontaminate import brute as brute_hits
from test_line_dedup import brute as brute_lines
from test_simhash import brute as brute_classes
from test_toxicity import corpus as toxic_corpus
from tokenizers import Tokenizer

import corpus_pipeline
from voltlake.llm.bpe import vocabulary_path


def tables(spark, path):
    texts, toxic = toxic_corpus(400, 5)
    r = random.Random(6)
    items = [(i, " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(r.choice([4, 13, 30])))) for i in range(20)]
    for i in range(0, 60, 3):
        texts[i + 1] += " " + items[i // 3][1]
    texts[40:44] = [texts[41]] * 4
    texts += [None, ""]
    toxic[40:44] = [0] * 4
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return toxic, items


def test_stages(spark, tmp_path):
    toxic, items = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        at[name] = (before, {r.doc_id: r.text for r in docs.collect()})
        assert docs.count() == len(at[name][1])
    ids = lambda d: sorted(d)
    before, after = at["toxicity"]
    assert len({*after} ^ {i for i in before if i >= len(toxic) or not toxic[i]}) <= 4  # a classifier's decisions
    assert all(after[i] == before[i] for i in after)
    before, after = at["line_dedup"]
    assert [after[i] for i in ids(before)] == brute_lines([before[i] for i in ids(before)])
    before, after = at["near_dedup"]
    found = brute_classes([before[i] for i in ids(before)])
    assert ids(after) == [i for k, i in enumerate(ids(before)) if found[k][1] == k]
    before, after = at["decontamination"]
    hits = brute_hits([before[i] for i in ids(before)], items)
    assert ids(after) == [i for k, i in enumerate(ids(before)) if not hits[k][-1]]
    assert any(h[-1] for h in hits)
    lib = Tokenizer.from_file(vocabulary_path())
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ids(rows) == ids(after)
    assert all(rows[i].ids == lib.encode(t or "", add_special_tokens=False).ids and rows[i].decoded == (t or "") for i, t in after.items())
