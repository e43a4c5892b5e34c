"""The pipeline against a brute-force version of its stages on a small table, and its stages' contracts."""

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from telewatch.llm import bpe, pii, quality
from tests.llm.test_decontaminate import held
from tests.llm.test_neardup import brute
from tests.llm.test_rules_quality import BAD, GOOD


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(7)
    path = tmp_path_factory.mktemp("tables")
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    items = [" ".join(word() for _ in range(20)) for _ in range(3)]
    texts, labels = [None, ""], [(0, 1, 0), (1, 1, 0)]
    for i in range(2, 240):
        good = rng.random() < 0.75
        t = " ".join(rng.choice(GOOD if good else BAD, 3)) + " " + " ".join(word() if good else "$$$" for _ in range(25))
        t += " " + items[i % 3] if good and i % 11 == 0 else ""
        t += " mail me@site.example.com" if i % 13 == 0 else ""
        texts.append(t)
        labels.append((i, int(good), 0))
    copies = [5, 9, 40]
    texts += [texts[i] for i in copies] + [texts[5] + " end"]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts, items


def test_run_equals_brute_force(spark, folder):
    path, texts, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{path}/labels.parquet"), quality.in_fold())
    alive = sorted(r.doc_id for r in quality.score(docs, model).filter("score >= 0.5").collect())
    assert 100 < len(alive) < len(texts)
    label, _ = brute([texts[i] for i in alive], 5, 80)
    alive = [alive[k] for k in sorted(set(label))]
    alive = [i for i in alive if all(held(texts[i], item) < 0.8 for item in items)]
    encoder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {}
    for i in alive:
        t = pii.mask(texts[i] or "", pii.find(texts[i] or ""))
        want[i] = (None if texts[i] is None else len(t), encoder.encode_ordinary(t))
    got = {r.doc_id: (r.n_chars, np.frombuffer(r.ids, "<u4").tolist()) for r in corpus_pipeline.run(spark, path).collect()}
    assert got == want and len(want) < 230


def test_stages_keep_the_columns(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("extra", __import__("pyspark").sql.functions.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), path).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).collect() == []
