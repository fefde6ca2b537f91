"""Each stage against a brute-force version, on all that its predecessor kept."""

from collections import defaultdict

import corpus_pipeline
import edge
from test_exact import brute as brute_copies
from test_near import brute as brute_near
from test_packing import check_pieces
from tidewheel.llm.tables import stored


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, folder))
        steps[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
            known = {r.doc_id: r for r in before.collect()}
            assert all(known[r.doc_id] == r for r in docs.collect())
    before, after = steps["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert sum(labels.get(i) == 0 for i in gone) <= 2

    rows = [(r.doc_id, r.text) for r in steps["exact_dedup"][0].collect()]
    assert sorted(r.doc_id for r in steps["exact_dedup"][1].collect()) == sorted(r[0] for r in brute_copies(rows, False) if r[3])

    rows = [(r.doc_id, r.text) for r in steps["near_duplicates"][0].collect()]
    assert sorted(r.doc_id for r in steps["near_duplicates"][1].collect()) == sorted(r[0] for r in brute_near(rows) if r[0] == r[3])

    before, after = steps["mixing"]
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before.collect():
        sizes[r.source] += len(r.text.split())
    for r in after.collect():
        taken[r.source] += len(r.text.split())
    assert all(taken[s] <= 3 * sizes[s] for s in sizes)

    before, after = steps["packing"]
    counts = defaultdict(int)
    for r in before.collect():
        counts[r.doc_id] += 1
    once = {r.doc_id: r.text for r in before.collect() if counts[r.doc_id] == 1}
    check_pieces(after.collect(), once)


def test_run_and_registration(spark, folder):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_edge_rows_pass_all_stages(spark, tmp_path):
    docs = edge.clashing(edge.documents(spark))
    spark.createDataFrame([(1, 0), (6, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = stored(stage(spark, rows, str(tmp_path)))
            if name != "packing":
                assert rows.columns == docs.columns
