import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from sameleaf.llm import near_duplicates, packing, quality
from sameleaf.llm.common import give_back

from .test_llm import junk_and_prose, prose


def write(spark, folder):
    r = random.Random(30)
    clean = [x for k, x in enumerate(junk_and_prose(100)) if k % 10 > 3]
    shared = "Licensed under the terms of a licence that everyone has."
    item = prose(30, r)
    texts = [*[f"{x}\n{shared}" for x in clean[:12]], *clean[12:], *[x for k, x in enumerate(junk_and_prose(100)) if k % 10 < 4], item + ". End.", clean[20] + " Once more.", None, ""]
    spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, shared, len(clean)


def test_stages(spark, tmp_path):
    texts, shared, n = write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs.withColumn("n_lines", F.lit(1)) if name == "line_dedup" else docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        seen[name] = {x.doc_id: x for x in docs.collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    leak, near = len(texts) - 4, len(texts) - 3
    assert set(range(n)) <= set(seen["quality"]) and not {*range(n, leak)} & set(seen["quality"]) and len(texts) - 2 not in seen["quality"]
    assert all(shared not in x.text for x in seen["line_dedup"].values()) and seen["line_dedup"][0].n_chars == len(seen["line_dedup"][0].text)
    assert set(seen["line_dedup"]) - set(seen["near_duplicates"]) == {near}
    assert leak in seen["near_duplicates"] and leak not in seen["decontamination"]
    assert set(seen["packing"]) == set(seen["decontamination"]) == set(range(n))


def test_run(spark, tmp_path):
    write(spark, tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_workers_hold_one_stage(spark, monkeypatch):
    """A worker process outlives its tasks: a stage drops what those before it keep there, and leaves no freed memory behind."""
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) >> 10

    docs, seen = spark.createDataFrame([], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: seen.append(f) or self)
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("One", (), {"partitionId": staticmethod(lambda: 0)}))}))
    packing.pack_documents(docs)
    near_duplicates.sketches(docs, 5)
    r = random.Random(31)
    texts = [" ".join(f"{chr(r.randrange(97, 123))}{r.randrange(1 << 16):x}" for _ in range(400)) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    quality._KNOWN["word"]
    assert sum(x.num_rows for x in seen[0](iter([batch]))) >= len(texts)
    assert packing._SHARED and not quality._KNOWN
    before = held()
    give_back()
    assert before - held() < 30
    assert sum(x.num_rows for x in seen[1](iter([batch.slice(0, 10)]))) == 10
    assert not packing._SHARED and not quality._KNOWN
