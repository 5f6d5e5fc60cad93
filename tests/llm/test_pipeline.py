"""The pipeline: contracts of its stages, and its rows against a plain run over sf0.001."""

import corpus_pipeline
from shelfwise.llm import decontaminate, quality_classifier, simhash, toxicity
from shelfwise.llm.common import read_table
from shelfwise.llm.queries import GOOD_AT, QUERIES, TOXIC_AT
from tests.llm import cases
from tests.llm.test_decontaminate import plain_distance
from tests.llm.test_simhash import plain_survivors

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {n.partition("_")[0] for n in QUERIES}
    assert set(QUERIES) <= set(names) and "pipeline" in names
    assert "op2_quality_rules" in __spark_entry__.oracle_sql()


def test_pipeline_against_a_plain_run(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    good = quality_classifier.train(docs, labels)
    toxic = toxicity.train(docs, labels)
    items = [decontaminate.normalise(r["text"]) for r in read_table(spark, SF, "benchmark").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {i: x for i, x in rows.items() if good.scores(quality_classifier.measured([x]))[0] >= GOOD_AT}
    rows = {i: x for i, x in rows.items() if toxic.score(x)[0] < TOXIC_AT}
    order = sorted(rows)
    rows = {order[k]: rows[order[k]] for k in plain_survivors([rows[i] for i in order])}

    def leaks(text):
        return any(plain_distance(a, text) <= decontaminate.budget(len(a)) for a in items if len(a) >= decontaminate.Q)

    want = {i for i, x in rows.items() if not leaks(decontaminate.normalise(x))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) == len(want) and {r["doc_id"] for r in got} == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_every_stage_on_odd_rows_and_an_empty_table(spark):
    odd, none = cases.with_odd_ids(spark), cases.documents(spark, [])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for docs in (odd, none):
            out = stage(spark, docs, SF)
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
    assert len(corpus_pipeline.STAGES) == 5 and simhash.MAX_BITS == 4
