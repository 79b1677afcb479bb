"""What keeps queries in proportion to their input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sameleaf.functions import text as T
from sameleaf.operators import joins as J
from sameleaf.operators import segment as S

DDL = "page int, ord int, text string"


def lines(seed, n):
    r = random.Random(seed)
    words = ["alpha", "be", "gamma,", "de", "x", "投标", "ÉÀ-f", "a.b", "😀", "  ", "文件"]
    base = [" ".join(r.choice(words) for _ in range(k % 7 + 1)) for k in range(12)]
    change = lambda x: " ".join(w if r.random() < 0.8 else r.choice(words) for w in x.split(" "))
    return [(k % 3, k, change(random.Random(k % 12).choice(base))) for k in range(n)]


@pytest.mark.parametrize("t", [0.5, 0.7, 0.95, 1.0])
@pytest.mark.parametrize("verify", ["diff", "cosine"])
def test_blocks_find_what_joins_of_vectors_find(spark, t, verify, monkeypatch):
    monkeypatch.setattr("sameleaf.functions.blocks.FEW", 7)
    a, b = spark.createDataFrame(lines(1, 60) + [(0, 60, ""), (0, 61, None)], DDL), spark.createDataFrame(lines(2, 40), DDL)
    rows = lambda d: sorted(tuple(x[c] for c in sorted(d.columns)) for x in d.collect())
    got, wanted = J.text_join(a, b, t, verify=verify), J.text_join(S.with_vectors(a), S.with_vectors(b), t, verify=verify)
    assert rows(got) == rows(wanted) and (got.count() or t == 1.0)
    for near in (True, False):
        got, wanted = (J.exclude(x, y, t, verify=verify, drop_without_candidates=near) for x, y in ((a, b), (S.with_vectors(a), S.with_vectors(b))))
        key = lambda d: sorted((x.page, x.text or "", x.ord) for x in d.where(F.col("text").isNotNull()).collect())
        assert key(got) == key(wanted)
    assert "Python" in got._jdf.queryExecution().toString() or "MapInArrow" in got._jdf.queryExecution().toString()


def test_cosines_are_counted_without_a_row_for_each_pair(spark):
    a, b = spark.createDataFrame(lines(1, 60), DDL), spark.createDataFrame(lines(2, 40), DDL)
    pairs = J.text_join(S.with_vectors(a), S.with_vectors(b), 0.7, verify="cosine").groupBy("b_text").agg(F.countDistinct("a_text").alias("n"), F.max("similarity").alias("best"))
    got = J.cosine_counts(a, b, 0.7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect()))
    assert "Join" not in got._jdf.queryExecution().toString()


def test_many_texts_are_joined_as_before(spark, monkeypatch):
    monkeypatch.setattr(J, "FEW_UNITS", 10)
    a, b = spark.createDataFrame(lines(1, 60), DDL), spark.createDataFrame(lines(2, 40), DDL)
    assert J.cosine_counts(a, b, 0.7) is None
    assert sorted(J.text_join(a, b, 0.7).collect()) == sorted(J.text_join(S.with_vectors(a), S.with_vectors(b), 0.7).collect())


def test_sentences_need_only_patterns_of_latin_characters(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("ab !?;。！？；‼‽⁇⁈⁉\n\t　\xa0 \u0085﻿😀\r中") for _ in range(r.randint(0, 14))) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    whole = T.sentences(F.trim(F.regexp_replace(T.halfwidth(F.col("t")), T.SPACE, " ")))
    assert df.select(T.clean_sentences(F.col("t")).alias("got"), whole.alias("wanted")).where("not (got <=> wanted)").count() == 0
    plan = df.select(T.clean_sentences(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\[[^\]\n]*[^\x00-\xff][^\]\n]*\]\+", plan)


def test_pairs_of_images_are_counted_as_they_are_made(spark):
    r = random.Random(7)
    hashes = ["".join(r.choice("01") for _ in range(40)) for _ in range(30)] + ["x" + "01" * 19 + "0", "x" + "01" * 19 + "1"]
    df = spark.createDataFrame([(1, k, str(k), h, 100, 100) for k, h in enumerate(hashes)], "page int, ord int, image string, image_hash string, width int, height int")
    made = J.image_join(df, df, 0.6, 100, 40, ordered=F.col("a_ord") < F.col("b_ord"))
    same = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / 40
    assert {(x.a_ord, x.b_ord, x.similarity) for x in made.collect()} == {(i, j, same(hashes[i], hashes[j])) for j in range(32) for i in range(j) if same(hashes[i], hashes[j]) > 0.6}
    join = [x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert any("bit_count" in x for x in join)  # not after pairs have been shuffled


def test_attributes_ride_along_with_pairs(spark, tmp_path):
    from sameleaf import queries

    rows = [(k, "t", "en" if k % 3 else None, "s" if k % 4 else "r", k % 5) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    made = queries.metadata_compare(spark, str(tmp_path))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    text = lambda x: None if x is None else str(x)
    wanted = {(a[0], b[0], "language", a[2], b[2], a[2] == b[2]) for a in rows for b in rows if a[0] < b[0] and a[3] == b[3]}
    wanted |= {(a[0], b[0], "size", text(a[4]), text(b[4]), a[4] == b[4]) for a in rows for b in rows if a[0] < b[0] and a[3] == b[3]}
    wanted |= {(a[0], b[0], "author", None, None, True) for a in rows for b in rows if a[0] < b[0] and a[3] == b[3]}
    assert sorted(map(repr, (tuple(x[c] for c in ("i", "j", "label", "a", "b", "same")) for x in made.collect()))) == sorted(map(repr, wanted))


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


def test_texts_are_dealt_instead_of_words(spark, tmp_path):
    from sameleaf import queries
    from sameleaf.operators import entities as E

    spark.createDataFrame([(k, "running station of nation") for k in range(9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = queries.entity_runs(spark, str(tmp_path))
    assert "text" not in made.columns and made.count() == 9
    first = exchanges(made)
    assert len(first) == 1 and "REPARTITION_BY_NUM" in first[0]
    assert not any(ord(c) > 255 for c in E.PUNCTUATION)
    words = spark.createDataFrame([(w,) for w in ["a", "é", "é。", "a.", "…", "中", "a b", "《中"]], "w string")
    assert [x[0] for x in words.select(E._punctuated(F.col("w"))).collect()] == [False, False, True, True, True, False, True, True]


def test_the_share_of_a_task_stays(spark, tmp_path):
    from sameleaf import queries
    from sameleaf.operators.deal import deal

    spark.range(1000).select(*[F.col("id").alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus")).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = queries.layout_paragraphs(spark, str(tmp_path))
    first = exchanges(made)
    assert len(first) == 1 and "REPARTITION_BY_NUM" in first[0] and made.count() == 1000
    df = spark.read.parquet(f"{tmp_path}/lineitem.parquet")
    assert deal(df, 500, "l_orderkey").rdd.getNumPartitions() > 8 and deal(df, 1 << 30, "l_orderkey").rdd.getNumPartitions() == 4
