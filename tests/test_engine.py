import time

from pyspark.sql import functions as F

from sameleaf.functions import text as T
from sameleaf.plans.compare import DocumentComparator, sentences_of
from sameleaf.plans.progress import Progress, duration_text, logger, set_log_handler
from sameleaf.settings import Settings
from sameleaf.sources import ingest
from sameleaf.sources.store import Store, group_rows, new_only
from sameleaf.streaming.preload import preload


def tables(spark):
    texts = [("h0", "f0", 0, "投标文件应当在截止日期前密封提交。\n评标委员会由五名专家共同组成。"), ("h1", "f1", 1, "投标文件应当在截止日期前密封提交。\n其他完全不同的一句话在这里写着。"), ("h2", "f2", 2, "hello world this is english")]
    docs = spark.createDataFrame(texts, "file_hash string, file_name string, ord int, text string").withColumn("metadata", F.create_map(F.lit("Author"), F.lit("x")))
    images = spark.createDataFrame([(h, 1, 0, "img_1", f"{h}.png", "01" * 50, 200, 200) for h in ("h0", "h1")], "file_hash string, page int, ord int, name string, image string, image_hash string, width int, height int")
    return docs, sentences_of(docs), images


def test_compare_and_history(spark, tmp_path):
    docs, sentences, images = tables(spark)
    told = []
    engine, lines, heard = DocumentComparator(spark, Settings().update(text={"min_length": 5}), Store(spark, str(tmp_path))), [], {}
    set_log_handler(lines.append)
    rows = engine.compare(docs.withColumn("file_path", F.concat(F.lit("/in/"), "file_name")), sentences, images, progress=lambda *x: told.append(x), pair_progress={"text": lambda p: lambda *x: heard.__setitem__(p, x)})
    set_log_handler(None)
    rows = {tuple(r.names): r for r in rows.collect()}
    assert rows["f0", "f1"].files == ["/in/f0", "/in/f1"] and rows["f0", "f1"].duration == rows["f0", "f1"].addtime - rows["f0", "f1"].starttime > 0
    assert set(heard) == {r.uuid for r in rows.values()} and heard[rows["f0", "f1"].uuid][1] == "1 / 1" and any("compared text: 1 matches" in x for x in lines)
    assert len(rows) == 3 and told[-1][:2] == ("1.0000", "4 / 4")
    same = rows["f0", "f1"]
    assert [m.similarity for m in same.textSimilarities] == [1.0]
    assert same.textSimilarities[0].a.textB.startswith("<b>")
    assert [m.images for m in same.imageMatches] == [["h0.png", "h1.png"]]
    assert [m.same for m in same.metadataMatches] == [True] * 4
    assert not rows["f0", "f2"].textSimilarities
    assert engine.history().count() == 3 and engine.history(same.groupid).count() == 3 and engine.history("none").count() == 0
    tender = sentences.where("file_hash = 'h1'").select("page", "ord", "text", "vector")
    again = {tuple(r.names): r for r in engine.compare(docs, sentences, images, tender=tender).collect()}
    assert not again["f0", "f1"].textSimilarities
    assert engine.history().count() == 6
    pair = engine.compare_pair(docs, sentences, images, "h1", "h0").collect()
    assert [(r.names, r.files, len(r.textSimilarities)) for r in pair] == [(["f1", "f0"], ["h1", "h0"], 1)]
    assert engine.store.result("none") is None and engine.store.import_json("none").count() == 0


def test_empty_documents(spark):
    docs, sentences, images = tables(spark)
    engine = DocumentComparator(spark)
    assert engine.compare(docs.limit(0), sentences.limit(0), images.limit(0)).count() == 0
    assert engine.compare_texts(engine.pairs(docs), sentences.limit(0)).count() == 0


def test_settings_ignore_nothing_given():
    s = Settings().update(text={"threshold": 0, "min_length": 15}, image={"similarity": 0.8})
    assert (s.text.threshold, s.text.min_length, s.image.similarity, s.image.min_size) == (0.7, 15, 0.8, 100)


def test_files_and_store(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_bytes(b"abc")
    (tmp_path / "in/deep/b.txt").write_bytes(b"abc")
    found = ingest.files(spark, str(tmp_path / "in"))
    assert {r.file_name for r in found.collect()} == {"a.txt", "b.txt"}
    assert {r.file_hash for r in found.collect()} == {"ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"}
    assert new_only(found, None).count() == 1 and new_only(found, found).count() == 0
    assert ingest.listing(spark, str(tmp_path / "in"), "*.txt").count() == 2
    store = Store(spark, str(tmp_path / "store"))
    rows = found.select("file_hash", "file_name").dropDuplicates(["file_hash"])
    for _ in range(2):
        store.add_parsed("files", rows, "file_hash string, file_name string")
    assert store.read("files", "file_hash string, file_name string").count() == 1
    store.keep_originals(found)
    kept = store.by_hash("originals", "file_hash string, file_name string, content binary", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad").collect()
    assert [bytes(r.content) for r in kept] == [b"abc"]


def test_parsed_json(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h/parse.json").write_text('{\n "fileName": "f", "filePath": "p", "fileHash": "h", "metadata": {"info": {"Author": "x"}},\n "texts": [{"pageNumber": 1, "text": "aab"}],\n "images": [{"name": "img_1", "pageNumber": 1, "image": "i", "imageHash": "01", "width": 1, "height": 2}]\n}')
    got = ingest.parsed(spark, str(tmp_path))
    assert got["documents"].first().metadata == {"Author": "x"}
    assert got["sentences"].first().vector == {"a": 2, "b": 1}
    assert got["images"].first().height == 2


def test_json_results(spark, tmp_path):
    docs, sentences, images = tables(spark)
    store = Store(spark, str(tmp_path))
    store.export_json(DocumentComparator(spark).compare(docs, sentences, images).coalesce(1), "g")
    (tmp_path / "result/g/broken.json").write_text("{")
    assert store.import_json("g").count() == 3


def test_grouping(spark):
    df = spark.createDataFrame([("g1", 1), ("g2", 2), ("g1", 3), (None, 4)], "groupid string, n int")
    got = sorted([x["n"] for x in r["items"]] for r in group_rows(df, "groupid", "n").collect())
    assert got == [[1, 3], [2], [4]]


def test_progress_and_log():
    told, now = [], iter(range(100))
    p = Progress(3, lambda *x: told.append(x), clock=lambda: next(now))
    for _ in range(3):
        p.step()
    assert told[-1] == ("1.0000", "3 / 3", "0秒") and len(told) == 3
    Progress(0, lambda *x: told.append(x))
    assert told[-1][1] == "0 / 0"
    assert duration_text(90_061_000) == "1天1小时1分钟1秒"
    lines = []
    set_log_handler(lines.append)
    logger.info("a %s", "b")
    set_log_handler(None)
    assert lines[0].endswith("a b") and time.strptime(lines[0][:19], "%Y-%m-%d %H:%M:%S")


def test_preload_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, x in enumerate(("one sentence! two", "one sentence! two", "other")):
        (tmp_path / f"in/{k}.txt").write_text(x)
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        preload(spark, store, str(tmp_path / "in"), str(tmp_path / "ck")).awaitTermination(60)
    schema = "file_hash string, page int, ord int, text string, vector map<string,int>"
    assert sorted(r.text for r in store.read("sentences", schema).collect()) == [" two", "one sentence!", "other"]


def test_nfkc(spark):
    assert spark.createDataFrame([("ﬁ①",), (None,)], "x string").select(T.nfkc("x")).collect()[0][0] == "fi1"
