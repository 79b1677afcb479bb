import random

import pytest
from pyspark.sql import functions as F

from sameleaf.functions.diff import diff
from sameleaf.operators import entities as E
from sameleaf.operators import joins as J
from sameleaf.operators import layout as L
from sameleaf.operators import segment as S


def sentences(spark, rows):
    return S.with_vectors(spark.createDataFrame(rows, "page int, ord int, text string"))


@pytest.mark.parametrize("t", [0.0, 0.5, 0.7, 0.9, 1.0, 1.1])
def test_ratio_join_is_the_nested_loop(spark, t):
    a, b = spark.range(1, 60).select(F.col("id").alias("la")), spark.range(1, 60).select(F.col("id").alias("lb"))
    got = {tuple(r) for r in J.ratio_join(a, b, "la", "lb", t).collect()}
    assert got == {(x, y) for x in range(1, 60) for y in range(1, 60) if t <= x / y <= 2 - t and t <= 1}


def test_text_join_is_the_definition(spark):
    r = random.Random(3)
    make = lambda n: [(1, k, "".join(r.choice("投标文件 应当密封") for _ in range(r.randint(4, 9)))) for k in range(n)]
    a, b = make(25), make(25)
    a.append((2, 25, a[0][2]))

    def cosine(x, y):
        c = lambda s: {k: s.count(k) for k in s}
        p, q = c(x), c(y)
        return sum(n * q.get(k, 0) for k, n in p.items()) / (sum(n * n for n in p.values()) ** 0.5 * sum(n * n for n in q.values()) ** 0.5)

    words = lambda n: [(1, 100 + k, " ".join(r.choice(["alpha", "be", "gamma,", "de", "x"]) for _ in range(r.randint(2, 6)))) for k in range(n)]
    a, b = a + words(25), b + words(25)
    wanted = {(i, j, diff(x, y)[0]) for _, i, x in a for _, j, y in b if 0.7 <= len(x) / len(y) <= 1.3 and cosine(x, y) >= 0.7 and diff(x, y)[0] >= 0.7}
    got = J.text_join(sentences(spark, a), sentences(spark, b), 0.7)
    assert {(x.a_ord, x.b_ord, x.similarity) for x in got.collect()} == wanted


@pytest.mark.parametrize("verify", ["diff", "cosine"])
def test_exclusion(spark, verify):
    tender = sentences(spark, [(1, 0, "投标文件应当密封")])
    texts = sentences(spark, [(1, 0, "投标文件应当密封"), (1, 1, "评标委员会由五人组"), (1, 2, "评标委员会由五人组"), (2, 3, "长" * 30)])
    got = J.exclude(texts, tender, 0.7, verify=verify).collect()
    assert [(x.page, x.text, x.ord, x.vector) for x in got] == [(1, "评标委员会由五人组", 1, None)]
    kept = J.exclude(texts, tender, 0.7, verify=verify, drop_without_candidates=False, drop_vectors=False).collect()
    assert {x.ord for x in kept} == {1, 3} and all(x.vector for x in kept)
    assert J.exclude(texts, None, 0.7).count() == 4
    assert J.exclude(texts, tender.limit(0), 0.7, verify=verify).count() == 0


def test_images(spark):
    ddl = "page int, ord int, image string, image_hash string, width int, height int"
    base = "01" * 50
    flip = lambda n: "".join("10"[int(c)] if k < n else c for k, c in enumerate(base))
    a = spark.createDataFrame([(1, 0, "a", base, 100, 100), (1, 1, "small", base, 99, 100), (1, 2, "empty", "", 100, 100)], ddl)
    b = spark.createDataFrame([(1, k, f"b{n}", flip(n), 100, 100) for k, n in enumerate((0, 9, 10))] + [(1, 3, "flat", base, 200, 180), (1, 5, "short", base[:-5], 100, 100), (1, 4, "none", "", 100, 100)], ddl)
    got = {(x.a_image, x.b_image): x.similarity for x in J.image_join(a, b, 0.9, 100, 100).collect()}
    assert got == {("a", "b0"): 1.0, ("a", "b9"): 0.91, ("a", "short"): 0.95}
    back = {(x.a_image, x.b_image) for x in J.image_join(b, a, 0.9, 100, 100).collect()}
    assert back == {("b0", "a"), ("b9", "a"), ("flat", "a"), ("short", "a")}  # the ratio of shapes isn't symmetric


def test_image_join_is_the_nested_loop(spark):
    r = random.Random(7)
    hashes = ["".join(r.choice("01") for _ in range(20)) for _ in range(40)]
    df = spark.createDataFrame([(1, k, str(k), h, 100, 100) for k, h in enumerate(hashes)], "page int, ord int, image string, image_hash string, width int, height int")
    same = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / 20
    for s in (0.5, 0.65, 0.8):
        got = {(x.a_ord, x.b_ord) for x in J.image_join(df, df, s, 100, 20, ordered=F.col("a_ord") < F.col("b_ord")).collect()}
        assert got == {(i, j) for j in range(40) for i in range(j) if same(hashes[i], hashes[j]) > s}


def test_metadata(spark):
    maps = spark.createDataFrame([({}, {}), ({"Author": "x"}, {})], "l map<string,string>, r map<string,string>")
    rows = J.compare_attributes(maps, "l", "r").collect()
    assert [x.same for x in rows] == [True] * 4 + [False, True, True, True]
    assert rows[4].label == "作者"


def test_document_pairs(spark):
    docs = spark.createDataFrame([(0, "a", "h"), (1, "b", "h"), (2, "c", "i")], "ord int, file_name string, file_hash string")
    assert sorted((x.i, x.j) for x in J.document_pairs(docs).collect()) == [(0, 1), (0, 2), (1, 2)]


def test_layout(spark):
    runs = [("A", 10.0, 50.0, 700.0, 100.0), ("B", 10.0, 155.0, 700.0, 100.0), ("C", 10.0, 50.0, 685.0, 500.0), ("D", 10.0, 50.0, 670.0, 100.0), ("T", 14.0, 50.0, 640.0, 80.0), ("", 10.0, 0.0, 0.0, 1.0), ("x", 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame([("f", 1, k, s, "font", h, w, x, y, 600.0) for k, (s, h, x, y, w) in enumerate(runs)], "file_hash string, page int, seq int, str string, font string, height double, width double, x double, y double, page_width double")
    assert [(x.str, x.x_s, x.x_e) for x in L.lines(df).orderBy("seq").collect()] == [("AB", 50, 250), ("C", 50, 550), ("D", 50, 150), ("T", 50, 130)]
    assert [x.text for x in L.paragraphs(df).orderBy("seq").collect()] == ["AB", "CD", "T"]
    assert [(x.ord, x.text) for x in L.page_sentences(df).orderBy("ord").collect()] == [(0, "AB"), (1, "CD"), (2, "T")]


def runs_of(spark, words):
    tokens = spark.createDataFrame([(1, k, *x.split("/")) for k, x in enumerate(words.split())], "doc_id long, idx int, word string, tag string")
    return sorted((x.type, x.entity) for x in E.by_runs(tokens, "doc_id").collect())


def test_entity_runs(spark):
    assert runs_of(spark, "位于/v 北京市/ns 。/x") == [("location", "北京市")]
    assert runs_of(spark, "北京/ns 市/n 海淀区/ns 。/x") == [("location", "北京市海淀区")]
    assert runs_of(spark, "本/n 综合大厦/n") == [("location", "综合大厦")]
    assert runs_of(spark, "第三/m 楼/n") == []
    assert runs_of(spark, " ".join(["甲/ns"] * 20) + " 县/ns 。/x") == [("location", "甲" * 19 + "县")]


def test_entity_runs_are_the_loop(spark):
    rule = E.RunRule("r", "Z$", frozenset("n"), frozenset(), ahead=3)
    r = random.Random(5)
    rows = [(d, k, r.choice(["a", "b", "Z", "."]), r.choice("nnnv")) for d in range(60) for k in range(12)]
    wanted = set()
    for d in range(60):
        own, run = [(w, t) for e, _, w, t in rows if e == d], []
        for k in range(len(own) + 1):
            part = False
            for j in range(k, min(k + 3, len(own))):
                w, t = own[j]
                if t != "n" or w == ".":
                    break
                if w == "Z":
                    part = True
                    break
            if part:
                run.append(k)
            elif run:
                wanted.add((d, run[0], "".join(own[i][0] for i in run)))
                run = []
    tokens = spark.createDataFrame(rows, "doc_id long, idx int, word string, tag string")
    assert {(x.doc_id, x.at, x.entity) for x in E.by_runs(tokens, "doc_id", (rule,)).collect()} == wanted


def test_entity_patterns_and_conditions(spark):
    text = "11010519491231002X 见《招标法》 2024年3月5日 (010)12345678 a.b@c.com https://x.y/z"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {(x.type, x.entity) for x in E.by_pattern(df, "doc_id", "text").collect()}
    assert got == {("ucc", text[:18]), ("idcard", text[:18]), ("paper", "《招标法》"), ("time", "2024年3月5日"), ("tel", "(010)12345678"), ("email", "a.b@c.com"), ("domain", "https://x.y")}
    tokens = spark.createDataFrame([(1, 0, "王小明", "x"), (1, 1, "无名氏", "x"), (1, 2, "李", "nr"), (1, 3, "13812345678", "m"), (1, 4, "12812345678", "m")], "doc_id long, idx int, word string, tag string")
    assert {(x.type, x.entity) for x in E.by_condition(tokens, "doc_id").collect()} == {("person", "王小明"), ("mobile", "13812345678")}


def test_deduplication(spark):
    df = spark.createDataFrame([("a", "x", None), ("a", "x", None), ("b", "x", None), ("c", "x", 3), ("c", "x", 4), ("d", "x", 5)], "entity string, type string, num int")
    assert {(x.entity, x.num) for x in E.deduplicate(df).collect()} == {("a", 2), ("b", None), ("c", 7), ("d", 5)}


def test_right_cut(spark):
    rule = E.RunRule("r", "Z$", frozenset("nv"), frozenset(), right_tags=frozenset("v"))
    rows = [(1, 0, "a", "n"), (1, 1, "xZ", "v"), (2, 0, "yZ", "v"), (2, 1, "zZ", "v")]
    tokens = spark.createDataFrame(rows, "doc_id long, idx int, word string, tag string")
    assert {(x.doc_id, x.entity) for x in E.by_runs(tokens, "doc_id", (rule,)).collect()} == {(1, "a"), (2, "yZ")}


def test_extract_runs_all_rules(spark):
    df = spark.createDataFrame([(1, "见《法》", [("王小明", "nr"), ("位于", "v"), ("北京市", "ns"), ("。", "x"), ("北京市", "ns")])], "doc_id long, text string, words array<struct<word:string,tag:string>>")
    assert {(x.type, x.entity) for x in E.extract(df, "doc_id", tagged="words").collect()} == {("paper", "《法》"), ("person", "王小明"), ("location", "北京市")}


def test_image_first(spark):
    odd = spark.createDataFrame([("f", 1, 0, "img_a", 1, 1, "paintXObject", None), ("f", 1, 1, "img_b", 1, 1, "fill", True), ("f", 1, 2, "img_c", 1, 1, "paintXObject", True)], "file_hash string, page int, ord int, name string, width int, height int, op string, found boolean")
    assert [x.ord for x in S.image_first(odd).collect()] == [2]
    rows = [("f", 1, 0, "img_a", 1, 1), ("f", 1, 1, "img_a", 1, 1), ("f", 2, 2, "img_a", 2, 2), ("f", 1, 3, "other", 1, 1)]
    got = S.image_first(spark.createDataFrame(rows, "file_hash string, page int, ord int, name string, width int, height int"))
    assert [x.ord for x in got.collect()] == [0]


def test_cosine_gate_is_a_filter_of_its_own(spark):
    a, b = "abcdefghij", "abcdefghij" + "zzzz"  # cosine 0.62, common characters 10 of 14
    gated = J.text_join(sentences(spark, [(1, 0, " ".join(a))]), sentences(spark, [(1, 0, " ".join(b))]), 0.7)
    assert gated.count() == 1  # spaces are characters, too: with them the vectors are close
    free = S.with_vectors(spark.createDataFrame([(1, 0, "，".join(a))], "page int, ord int, text string")).withColumn("vector", F.lit(None).cast("map<string,int>"))
    assert J.text_join(free, free, 1.0).count() == 1
    tight = lambda x: spark.createDataFrame([(1, 0, x)], "page int, ord int, text string").withColumn("vector", F.create_map(F.lit(x[:1]), F.lit(1)))
    assert J.text_join(tight("ab c d e"), tight("xb c d e"), 0.7).count() == 0  # alike, but the gate says no
