import __spark_entry__ as entry


def test_sql_belongs_to_queries():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"sentences", "text_join", "entity_patterns", "layout_lines"} <= set(queries)


def test_entry_and_sql_agree_on_a_fixture(spark, tmp_path):
    """A query over a small table and its SQL give the same rows."""
    import duckdb

    rows = [(0, "Hello! world?? a.\n second line; more"), (1, "（ＡＢ） c\n\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("sentences", "min_length", "content_hashes", "bracket_balance", "utf16_lengths"):
        made = entry.queries()[name](spark, str(tmp_path))
        columns = sorted(made.columns)
        got = sorted(tuple(r[c] for c in columns) for r in made.collect())
        found = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        assert got == sorted(tuple(r) for r in found), name


def test_the_diff_and_its_sql_agree(spark, tmp_path):
    """Sentences of few words, so that many are alike in part; SQL walks the alignment by itself."""
    import random

    import duckdb

    r = random.Random(4)
    line = lambda: " ".join(r.choice(["alpha", "be", "gamma,", "de", "x", "投标", "ÉÀ-f", "a.b"]) for _ in range(r.randint(3, 7)))
    base = [line() for _ in range(12)]
    change = lambda x: " ".join(w if r.random() < 0.8 else r.choice(["be", "new", "投"]) for w in x.split())
    texts = {"documents": [(k, "\n".join(change(r.choice(base)) for _ in range(6))) for k in range(8)], "benchmark": [(k, "\n".join(change(r.choice(base)) for _ in range(4))) for k in range(5)]}
    con = duckdb.connect()
    for name, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        spark.createDataFrame(texts[name], f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name, least in (("text_join", 10), ("exclusion_diff", 5), ("entity_rules", 20)):
        made = entry.queries()[name](spark, str(tmp_path))
        columns = sorted(made.columns)
        got = sorted(tuple(r[c] for c in columns) for r in made.collect())
        found = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        assert got == sorted(tuple(r) for r in found) and len(got) >= least, name
    assert {x[columns.index("type")] for x in got} == {"location", "organization", "system", "person", "time", "mobile", "tel", "ucc", "email", "idcard", "domain", "paper"}
