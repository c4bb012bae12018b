import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__
from prepkit.llm import queries
from tests.llm.conftest import ODD
from tests.llm.test_decontamination import slow as slow_contained
from tests.llm.test_line_dedup import slow as slow_lines
from tests.llm.test_near_copies import slow as slow_copies


def written(frame, tmp_path, name):
    path = str(tmp_path / name)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def test_stages_against_brute_force(spark, sf_dir, table, tmp_path):
    docs = table("documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    outs, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, sf_dir), tmp_path, name)
        outs.append(now)
        if name != "packing":
            assert now.dtypes == docs.dtypes
    rows = [{r["doc_id"]: r for r in out.collect()} for out in outs[:4]]
    first, lines, near, clean = rows
    source = {r["doc_id"]: r for r in docs.collect()}
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert set(first) == {i for i, r in source.items() if letters(r["text"])}  # the languages are easy
    want = slow_lines([(i, r["text"]) for i, r in first.items()])
    assert {i: r["text"] for i, r in lines.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values())
    assert set(near) == set(slow_copies([(i, r["text"]) for i, r in lines.items()]).values())
    items = [(r["item_id"], r["text"]) for r in table("benchmark").collect()]
    leaks = {d for d, _ in slow_contained([(i, r["text"]) for i, r in near.items()], items)}
    assert set(clean) == set(near) - leaks
    assert {r["doc_id"] for r in outs[4].select("doc_id").distinct().collect()} == set(clean)


def test_run_gives_the_last_stage(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(found.columns)
    assert found.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_stages_take_odd_rows(spark, sf_dir, docs, tmp_path):
    for name, rows in (("odd", docs(ODD)), ("none", docs(ODD).where("false"))):
        now = rows
        for stage_name, stage in corpus_pipeline.STAGES:
            now = written(stage(spark, now, sf_dir), tmp_path, f"{name}-{stage_name}")
        assert (now.count() > 0) == (name == "odd")


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())
