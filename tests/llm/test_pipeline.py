"""The corpus pipeline and the registry."""
import corpus_pipeline
from cohortlens.llm import catalog, common

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    names = catalog.load_all()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(catalog.oracle_sql()) <= set(names)


def test_stages_work_on_what_the_one_before_kept(spark):
    docs = common.read_table(spark, SF, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    kept, tables = set(before), {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, SF), f"test-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= kept
        tables[name], kept, docs = out, ids, out
    quality = {r.doc_id: r.quality for r in common.read_table(spark, SF, "labels").collect()}
    accepted = {r.doc_id for r in tables["filter_quality"].select("doc_id").collect()}
    right = [(quality[i] == 1) == (i in accepted) for i in before if i in quality]
    assert sum(right) / len(right) > 0.9
    texts = [r.text for r in tables["drop_near_duplicates"].collect()]
    assert len(texts) == len(set(texts))
    packed = tables["pack_sequences"].collect()
    assert all(r.length <= 2048 for r in packed)


def test_stages_take_hard_rows_and_empty_tables(spark, hard, empty):
    for docs in (hard, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = common.materialize(stage(spark, docs, SF), f"hard-{name}")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            docs = out
            if docs.columns != hard.columns:
                break
