"""The pipeline's stages against what they promise, on real and on odd documents."""

import corpus_pipeline
import pytest
from tests_llm_data import EXTRA

from tidepool.llm import secrets, simhash
from tidepool.llm.common import written

SMALL = "/root/testdata/sf0.001"


def _stages(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SMALL), "test"))
    return out


def test_stages_on_documents(spark, sample):
    docs, kept, clean, single, masked, packed = _stages(spark, sample)
    for df in (kept, clean, single, masked):
        assert df.columns == docs.columns
    assert docs.count() >= kept.count() >= clean.count() >= single.count() == masked.count() > 0
    # One of each class stays, the smallest id.
    classes = {r["component_id"] for r in simhash.near_duplicates(clean).collect()}
    assert {r["doc_id"] for r in single.collect()} == classes
    assert all(not secrets.find_spans(r["text"]) for r in masked.collect())
    totals = packed.groupBy("doc_id").sum("length").join(packed.select("doc_id", "doc_tokens").distinct(), "doc_id")
    assert totals.where("`sum(length)` <> doc_tokens").count() == 0
    assert packed.select("doc_id").distinct().count() == masked.count()


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SMALL).columns[:3] == ["doc_id", "start", "length"]


def test_stages_on_odd_documents(spark, edge):
    docs, *rest = _stages(spark, edge)
    assert all(df.columns == docs.columns and set(EXTRA) <= set(df.columns) for df in rest[:-1])
    _, *none = _stages(spark, edge.limit(0))
    assert all(df.count() == 0 for df in none)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_names(name):
    assert name.isidentifier()
