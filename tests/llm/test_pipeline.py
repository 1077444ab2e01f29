import random

import pytest
from test_pairs import brute
from test_rows import junk, prose
from tallyforge.llm import pii

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, make, odd):
    r = random.Random(11)
    rows = [(k, prose(r)) for k in range(200)] + [(200 + k, junk(r, k % 4)) for k in range(40)]
    rows += [(300 + k, rows[k][1]) for k in range(20)] + [(400, rows[9][1] + " mail a@b.org")]
    docs, kept_columns = make(rows), make([]).columns
    (_, judge), (_, near), (_, mask), (_, pack) = corpus_pipeline.STAGES
    good = judge(spark, docs, "")
    assert good.columns == kept_columns
    left = [(x.doc_id, x.text) for x in good.collect()]
    ids = {i for i, _ in left}
    assert len(ids & set(range(200))) >= 196 and len(ids & set(range(200, 240))) <= 1
    good = make(left)
    one = near(spark, good, "")
    assert one.columns == kept_columns
    got = sorted((x.doc_id, x.text) for x in one.collect())
    assert [i for i, _ in got] == sorted(i for i, _, c in brute(left) if i == c)
    masked = mask(spark, make(got), "")
    assert masked.columns == kept_columns
    texts = {x.doc_id: x.text for x in masked.collect()}
    assert texts == {i: pii.mask(t, pii.all_spans(t)[1]) for i, t in got}
    packed = pack(spark, masked, "").collect()
    assert {x.doc_id for x in packed} == set(texts)


def test_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert "pipeline" in found and sum(k.startswith("op") for k in found) >= 10 and len(corpus_pipeline.STAGES) == 4
