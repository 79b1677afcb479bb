import pytest
from pyspark.sql import functions as F

from sameleaf.functions import images as I
from sameleaf.functions import text as T
from sameleaf.functions.diff import align, could_reach, diff


def one(spark, c, **columns):
    df = spark.createDataFrame([tuple(columns.values())], [*columns]) if columns else spark.range(1)
    return df.select(c).first()[0]


def test_vector_and_cosine(spark):
    assert one(spark, T.vector(F.col("x")), x="aab") == {"a": 2, "b": 1}
    assert one(spark, T.vector(F.col("x")), x="a😀a😃") == {"a": 2, "D83D": 2, "DE00": 1, "DE03": 1}
    cos = T.cosine(T.vector(F.col("x")), T.vector(F.col("y")))
    assert one(spark, cos, x="aab", y="abb") == 0.7999999999999998
    assert one(spark, cos, x="投标文件应当密封", y="投标文件必须密封") == 0.7499999999999999
    assert one(spark, T.cosine(F.create_map().cast("map<string,int>"), F.create_map(F.lit("a"), F.lit(1)))) == 0


@pytest.mark.parametrize("a, b, t, ok", [(10, 7, 0.7, False), (7, 10, 0.7, True), (13, 10, 0.7, True), (10, 13, 0.7, True), (12, 10, 0.8, True), (11, 10, 0.9, True)])
def test_length_ratio_is_not_symmetric(spark, a, b, t, ok):
    assert one(spark, T.in_range(F.lit(float(a)) / F.lit(float(b)), t)) is ok


def test_sentences(spark):
    assert one(spark, T.clean_sentences(F.col("x")), x="Hello! world?? a. b;c。 d") == ["Hello!", " world?", " a. b;", "c。", " d"]
    assert one(spark, T.clean_sentences(F.col("x"), compose=True), x="ＡＢＣ！　你好") == ["ABC!", " 你好"]
    assert one(spark, T.squeeze(F.col("x")), x=" a 　﻿ b\n") == "a b"
    assert one(spark, T.clean_sentences(F.col("x")), x="") == []


def test_scalars(spark):
    assert one(spark, T.utf16_length(F.col("x")), x="a😀中") == 4
    assert [one(spark, T.brackets_balanced(F.col("x")), x=x) for x in (")(", "(a", "《》", "", "<", "“”", "”", "［")] == [True, False, True, True, False, True, False, True]
    assert [one(spark, T.duration(F.lit(ms))) for ms in (0, 61_000, 3_600_000, 90_061_000)] == ["0秒", "1分钟1秒", "1小时0秒", "1天1小时1分钟1秒"]
    assert one(spark, T.percent(F.lit(1), F.lit(3))) == "0.3333"
    assert one(spark, T.basename(F.col("x")), x="/a/b.pdf") == "b.pdf"
    assert bytes(one(spark, T.unbase64_text(F.lit("_-8")))) == b"\xff\xef"
    assert one(spark, T.halfwidth(F.col("x")), x="（Ａ１）") == "(A1)"


def test_image_hashes(spark):
    for grey, wanted in (([0.0, 0, 10, 10], "0011"), ([5.0, 5, 5, 5], "0000")):
        assert one(spark, I.average_hash(F.array(*map(F.lit, grey)))) == wanted
    same = I.hash_similarity(F.col("x"), F.col("y"))
    assert [one(spark, same, x=x, y=y) for x, y in (("0011", "0010"), ("", "0011"), ("", ""))] == [0.75, 0.0, None]
    assert [one(spark, I.channels(F.lit(n), F.lit(2), F.lit(2))) for n in (12, 16, 13, 0)] == [3, 4, None, None]
    assert one(spark, I.hash_or_empty(F.array(F.lit(0.0), F.lit(1.0)), F.lit(None).cast("int"))) == ""
    assert I.differing(100, 0.9) == 9


def test_diff():
    assert diff("投标文件应当密封", "投标文件必须密封") == (0.75, "<b>投标文件</b>应当<b>密封</b>", "<b>投标文件</b>必须<b>密封</b>")
    assert diff("restaurant", "aura")[0] == 0
    assert diff("", "") == (1.0, "", "")
    assert diff("foo bar baz", "foo qux baz")[0] == 8 / 11
    assert diff("😀甲", "😀乙")[0] == 2 / 3  # UTF-16 code units
    assert diff("foo baz", "foo bar baz")[0] == 7 / 11


def test_alignment_is_longest():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    texts = st.lists(st.sampled_from("abc"), max_size=9)

    @settings(max_examples=200, deadline=None)
    @given(texts, texts)
    def check(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = align(a, b)
        assert len(got) == table[-1][-1]
        assert all(a[i] == b[j] for i, j in got) and got == sorted(got) and len({i for i, _ in got}) == len(got) == len({j for _, j in got})
        x, y = " ".join(a), " ".join(b)
        assert could_reach(x, y, diff(x, y)[0] - 1e-9)

    check()
