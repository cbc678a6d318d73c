"""The registered queries, and the pipeline against its stages done plainly."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from haplomill.llm import registry
from tests.test_oracle import TABLES, rows

from .test_near_dup import groups
from .test_packing import check



def test_all_are_registered():
    names = __spark_entry__.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    ours, theirs = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLES[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    assert rows(ours, columns) == rows(theirs, columns)


def test_pipeline_stages(spark, docs, sf):
    from haplomill.llm import language, quality

    judged = {(r["doc_id"], r["n_words"]) for r in quality.judge(docs).where("kept").collect()}
    good = docs.transform(lambda d: corpus_pipeline.quality_rules(spark, d, sf)).cache()
    assert good.count() == quality.judge(docs).where("kept").count() and judged
    known = corpus_pipeline.language_id(spark, good, sf).cache()
    assert known.count() == language.identify(good).where(f"lang_pred <> 'und' AND score >= {language.MIN_SCORE}").count()
    single = corpus_pipeline.near_dedup(spark, known, sf).cache()
    assert single.columns == docs.columns
    assert single.count() == groups([(r["doc_id"], r["text"]) for r in known.collect()], 5)[1]
    packed = corpus_pipeline.pack(spark, single, sf).collect()
    used, least = check(packed, [(r["doc_id"], r["text"]) for r in single.collect()], 2048)
    assert used <= least + 1


def test_whole_pipeline(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()
    assert out.select("doc_id").distinct().count() > 100
