import random

import pytest
from pyspark.sql import types as T

import corpus_pipeline

from . import data
from .test_toxicity import LABELS

NAMES = ["toxicity", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "best-fit packing"]


@pytest.fixture()
def folder(spark, tmp_path):
    rng = random.Random(0)
    rows = [(i, data.text(rng, 60) + (" blorgh" if i % 5 == 0 else "")) for i in range(60)]
    passage = data.text(rng, 60)
    rows += [(100 + i, data.text(rng, 30) + "\n" + passage) for i in range(4)]
    near = data.words(rng, 200)
    rows += [(200 + i, " ".join(near[:100] + [f"edit{i}"] + near[101:])) for i in range(3)]
    rows += [(300, rows[1][1]), (301, None), (302, ""), (None, "no id")]
    docs = data.documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("blorgh" in (t or ""))) for i, t in rows if i is not None and i < 60], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_do_what_they_say(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder).cache()
        assert out.columns == docs.columns
        kept[name] = {r["doc_id"]: r["text"] for r in out.collect()}
        docs = out
    toxic = set(range(0, 60, 5))
    assert not toxic & set(kept["toxicity"]) and len(kept["toxicity"]) == 71 - len(toxic)
    lines = kept["line dedup"]
    assert "\n" in lines[100] and all("\n" not in lines[100 + i] for i in (1, 2, 3)) and 300 not in lines and lines[302] == "" and 301 in lines
    near = kept["MinHash near-dedup"]
    assert 200 in near and 201 not in near and 202 not in near and len(near) == len(lines) - 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_run_on_an_empty_table(spark, tmp_path):
    data.documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
