"""Registered queries against their SQL, and the pipeline against its stages one by one."""

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from compare import connect, differences
from test_text_operators import brute_copies, brute_lines, check_packing

from dischargelab.llm import langid, pii, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, small, name):
    assert differences(queries.QUERIES[name](spark, small).toPandas(), connect(small).execute(queries.ORACLES[name]).df()) is None


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    names, scores = langid.fit(docs).predict(pa.array([t for _, t in rows]))
    rows = [r for r, n, s in zip(rows, names, scores) if n != "und" and s >= langid.MIN_SCORE]
    rows = sorted((i, t) for i, _, _, t in brute_lines(rows))
    rows = brute_copies(rows)
    rows = [(i, pii.mask(t, [s for s in pii.find(t) if s[0] in corpus_pipeline.MASKED])) for i, t in rows]
    check_packing(corpus_pipeline.run(spark, small).toPandas(), rows)


def test_stages_keep_columns_and_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            if name != "packing":
                assert out.columns == docs.columns, name
            assert np.isfinite(out.count())
