"""The pipeline, stage by stage and as a whole, against plain versions."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from peakloom.llm import decontaminate, packing, pii, quality
from peakloom.llm.common import NON_WORD, hash_words

from ..conftest import DATA
from .test_operators import jaccard_truth


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(out[-1], docs.schema) if len(out) > 1 else docs
        out.append(stage(spark, docs, DATA).toPandas())
    return out


def test_quality(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{DATA}/documents.parquet"), labels)
    score = model.score(quality.statistics([t.encode() for t in stages[0].text]))
    assert set(stages[1].doc_id) == set(stages[0].doc_id[score >= 0.3])


def test_near_duplicates(stages):
    _, truth = jaccard_truth(dict(zip(stages[1].doc_id, stages[1].text)), 5, 80)
    assert set(stages[2].doc_id) == set(truth.values())


def test_decontamination(spark, stages):
    items = [hash_words([r["text"].lower().encode()], NON_WORD)[0] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaks = set()
    for doc, text in zip(stages[2].doc_id, stages[2].text):
        h = hash_words([text.lower().encode()], NON_WORD)[0]
        for item in items:
            if len(np.intersect1d(item, h)) < len(item) / 2:
                continue  # an alignment at the threshold has more words in common
            score = decontaminate.smith_waterman(item, h)[0]
            if score >= 2 * max(0.5 * len(item), min(8, len(item))):
                leaks.add(doc)
    assert leaks and set(stages[3].doc_id) == set(stages[2].doc_id) - leaks


def test_personal_data(stages):
    assert list(stages[4].doc_id) == list(stages[3].doc_id)
    for before, after in zip(stages[3].text, stages[4].text):
        assert ("<" in after and after != before) if pii.spans(before) else after == before
        assert not [s for s in pii.spans(after) if s[3]]


def test_packing(stages):
    tok = packing.CachedTokenizer(packing.default_vocabulary())
    ids = {d: np.frombuffer(tok._whole(t), np.uint32).tolist() + [2] for d, t in zip(stages[4].doc_id, stages[4].text)}
    got = stages[5]
    assert got.length.sum() == sum(map(len, ids.values()))
    for r in got.itertuples():
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], np.uint32).tobytes()) == r.ids_crc32


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, DATA).toPandas()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got[columns].values)) == sorted(map(tuple, stages[5][columns].values))
