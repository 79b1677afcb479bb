"""Queries over the driver's tables, one for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import images as I
from .functions import text as T
from .functions.tagging import simple_tagger
from .operators import entities as E
from .operators import joins as J
from .operators import layout as L
from .operators import segment as S
from .operators.deal import deal
from .sources.ingest import content_hash
from .sources.store import group_rows

RATIO, CLOSE, IMAGE, MIN_LENGTH = 0.7, 0.95, 0.7, 10
PHRASES = (E.RunRule("phrase", "(tion|ing)$", frozenset(("n", "nr", "v")), frozenset(("v",)), valid=lambda e: F.length(e) >= 6),)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sentences(spark: SparkSession, d: str, table: str, key: str) -> DataFrame:
    return S.line_sentences(read(spark, d, table), key)


def sentences(spark, d):
    return _sentences(spark, d, "documents", "doc_id").select("doc_id", "page", "ord", "text")


def char_vector(spark, d):
    """Every other sentence gets characters beyond the basic plane, of which two share a code unit."""
    own = _sentences(spark, d, "benchmark", "item_id").withColumn("text", F.concat("text", F.when(F.col("ord") % 2 == 0, "😀中😃").otherwise("")))
    made = S.with_vectors(own)
    return made.select("item_id", "ord", F.explode("vector").alias("ch", "n"))


def min_length(spark, d):
    return S.at_least(_sentences(spark, d, "documents", "doc_id"), MIN_LENGTH).groupBy("doc_id").agg(F.count("*").alias("n_sentences"))


def _different(spark, d, table, key, side):
    own = S.at_least(_sentences(spark, d, table, key), MIN_LENGTH).select(F.col("text").alias(f"{side}_text")).distinct()
    return own.withColumn(f"{side}_len", T.utf16_length(F.col(f"{side}_text")))


def length_ratio_pairs(spark, d):
    pairs = J.ratio_join(_different(spark, d, "documents", "doc_id", "a"), _different(spark, d, "benchmark", "item_id", "b"), "a_len", "b_len", RATIO)
    return pairs.groupBy("b_text").agg(F.count("*").alias("n_pairs"), F.sum("a_len").cast("long").alias("sum_len"))


def cosine_pairs(spark, d):
    own = lambda table, key: S.at_least(_sentences(spark, d, table, key), MIN_LENGTH)
    counted = J.cosine_counts(own("documents", "doc_id"), own("benchmark", "item_id"), RATIO)
    if counted is not None:
        return counted.withColumn("best", F.round("best", 9))
    a, b = _different(spark, d, "documents", "doc_id", "a"), _different(spark, d, "benchmark", "item_id", "b")
    a, b = a.withColumn("va", T.vector(F.col("a_text"))), b.withColumn("vb", T.vector(F.col("b_text")))
    pairs = J.ratio_join(a, b, "a_len", "b_len", RATIO).select("b_text", T.cosine(F.col("va"), F.col("vb")).alias("cosine")).where(F.col("cosine") >= RATIO)
    return pairs.groupBy("b_text").agg(F.count("*").alias("n_pairs"), F.round(F.max("cosine"), 9).alias("best"))


def _both(spark, d):
    return S.at_least(_sentences(spark, d, "documents", "doc_id"), MIN_LENGTH), S.at_least(_sentences(spark, d, "benchmark", "item_id"), MIN_LENGTH)


def _text_join(spark, d, threshold, verify):
    a, b = _both(spark, d)
    # doc_id and item_id ride in page and ord, so that a match tells where it is
    pack = lambda df, key: df.select(F.col(key).cast("long").alias("page"), "ord", "text")
    found = J.text_join(pack(a, "doc_id"), pack(b, "item_id"), threshold, verify=verify)
    return found.select(F.col("a_page").alias("doc_id"), F.col("a_ord").alias("doc_ord"), F.col("b_page").alias("item_id"), F.col("b_ord").alias("item_ord"), "similarity", "a_marked", "b_marked")


def text_join(spark, d):
    return _text_join(spark, d, RATIO, "diff")


def text_join_cosine(spark, d):
    return _text_join(spark, d, CLOSE, "cosine").select("doc_id", "doc_ord", "item_id", "item_ord", F.round("similarity", 9).alias("similarity"))


def _excluded(spark, d, verify):
    a, b = S.at_least(_sentences(spark, d, "documents", "doc_id"), MIN_LENGTH), _sentences(spark, d, "benchmark", "item_id")
    return J.exclude(a, b, CLOSE, verify=verify, on=["doc_id"]).select("doc_id", "page", "text", "ord")


def exclusion(spark, d):
    return _excluded(spark, d, "cosine")


def exclusion_diff(spark, d):
    return _excluded(spark, d, "diff")


def document_pairs(spark, d):
    docs = read(spark, d, "benchmark").select(F.col("item_id").alias("ord"), F.concat(F.lit("item-"), "item_id").alias("file_name"), F.sha2("text", 256).alias("file_hash"))
    return J.document_pairs(docs)


def metadata_compare(spark, d):
    value = lambda c: F.col(c).cast("string")
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("ord"), value("doc_id").alias("file_name"), value("doc_id").alias("file_hash"), "source", F.create_map(F.lit("lang"), value("lang"), F.lit("n_chars"), value("n_chars")).alias("meta"))
    pairs = J.document_pairs(docs, within=["source"], carry=("meta",))
    return J.compare_attributes(pairs, "meta_l", "meta_r", (("lang", "language"), ("n_chars", "size"), ("author", "author")), "i", "j")


def _images(spark, d):
    hashed = read(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), I.average_hash(F.col("embedding")).alias("image_hash"))
    return hashed.select(F.lit(1).alias("page"), "ord", F.col("ord").cast("string").alias("image"), "image_hash", (90 + F.col("ord") % 7 * 10).cast("int").alias("width"), (95 + F.col("ord") % 5 * 10).cast("int").alias("height"))


def average_hash(spark, d):
    return _images(spark, d).select(F.col("ord").alias("vec_id"), "image_hash")


def hash_similarity(spark, d):
    own = average_hash(spark, d)
    other = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("image_hash").alias("next_hash"))
    return own.join(other, "vec_id").select("vec_id", I.hash_similarity(F.col("image_hash"), F.col("next_hash")).alias("similarity"))


def image_pairs(spark, d):
    images = _images(spark, d)
    found = J.image_join(images, images, IMAGE, 100, 64, ordered=F.col("a_ord") < F.col("b_ord"))
    return found.select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b"), "similarity")


def _counted(found):
    return E.deduplicate(found, ("key", "entity", "type")).withColumn("num", F.coalesce("num", F.lit(1)))


def entity_patterns(spark, d):
    docs = read(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), "text")
    pages = read(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("key"), F.concat_ws(" ", "url", "html").alias("text"))
    return _counted(E.by_pattern(docs.unionByName(pages), "key", "text"))


def _tokens(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode(simple_tagger(F.col("text"))).alias("idx", "t")).select(key, "idx", "t.word", "t.tag")


def entity_conditions(spark, d):
    rows = read(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), "text")
    return _counted(E.by_condition(_tokens(rows, "key"), "key"))


#: Tagged words that the rules for entities speak of; {k} is the item's number.
TAGGED = (
    "位于/v 北京市/ns 海淀区/ns 中关村/n 大街/n {k}/m 号/q 。/x 见/v 表/n 1/m 号/n ，/x 中国/ns 第三/m 层/q",
    "由/p 全国/n 建设/vn 工程/n 管理/vn 中心/n 主办/v ，/x 王小明/nr 与/c 无名氏/x 、/x 李四/x 、/x 欧/nr 到/v 训练/vn 场所/n",
    "使用/v 甲/x 电子/n 招标/vn 投标/vn 管理/vn 系统/n （/x 测试/vn ）/x ，/x 接入/v 国家/n 电力/n 互联网/n 。/x (/x 乙/x 公共/b 资源/n 交易/vn 平台/n",
    "电话/n 1380000{k4}/m ，/x 1280000{k4}/m ，/x 上海市/ns {k}/m 公司/n 人民/n 医院/n 。/x 全部/n 建设/vn 都/n",
    "{many}",
)
WRITTEN = "于2024年3月{day}日 或 2023-1 - 2 电话(010){k8}，（0755）1234567、021-{k8} 代码 91110108MA01{k4}XY 证件 11010519491231{k3}X 见《招标{k}法》《》 信箱 a.b+{k}@c-d.com 网址 https://x{k}.y/z 与 http://%E4%b8.cn"


def entity_rules(spark, d):
    """All twelve rules, over templates that hold what they look for."""
    k = F.col("item_id")
    values = {"{k}": k.cast("string"), "{k3}": F.lpad((k % 1000).cast("string"), 3, "0"), "{k4}": F.lpad((k % 10000).cast("string"), 4, "0"), "{k8}": F.lpad(k.cast("string"), 8, "1"), "{day}": (k % 28 + 1).cast("string"), "{many}": F.concat(F.repeat(F.lit("甲/ns "), (k % 23).cast("int")), F.lit("县/ns 。/x"))}

    def filled(c):
        for name, value in values.items():
            c = F.replace(c, F.lit(name), value)
        return c

    tagged = filled(F.element_at(F.array(*map(F.lit, TAGGED)), (k % len(TAGGED) + 1).cast("int")))
    words = F.transform(F.split(tagged, " "), lambda w: F.struct(F.regexp_extract(w, "^(.*)/([a-z]+)$", 1).alias("word"), F.regexp_extract(w, "^(.*)/([a-z]+)$", 2).alias("tag")))
    made = read(spark, d, "benchmark").select("item_id", filled(F.lit(WRITTEN)).alias("text"), words.alias("words"))
    return E.extract(made, "item_id", tagged="words").select("item_id", "entity", "type", F.coalesce("num", F.lit(1)).alias("num"))


def entity_runs(spark, d):
    # Texts are dealt, not their words, which are several times as large.
    docs = deal(read(spark, d, "documents").select("doc_id", "text"), 8 << 20, "doc_id")
    return E.by_runs(_tokens(docs, "doc_id"), "doc_id", PHRASES).select("doc_id", F.col("at").cast("int").alias("at"), "entity")


def _glyphs(spark, d):
    """Each file has one page. They are dealt by the input's size, so that a task sorts as much at any size."""
    n = F.col("l_linenumber")
    used = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    return deal(read(spark, d, "lineitem").select(*used), 2 << 20, "l_orderkey").select(
        F.col("l_orderkey").alias("file_hash"), F.lit(1).alias("page"), (n * F.lit(10**12) + F.col("l_partkey") * 10**6 + F.col("l_suppkey")).cast("long").alias("seq"), F.concat("l_returnflag", "l_linestatus", n.cast("string")).alias("str"),
        F.when(F.col("l_partkey") % 5 == 0, 14.0).otherwise(10.0).alias("height"), (F.col("l_suppkey") % 60 + 60).cast("double").alias("width"),
        (n * 95 + F.col("l_partkey") % 9).cast("double").alias("x"), (700 - F.floor(n / 3) * 15).cast("double").alias("y"), F.lit(600.0).alias("page_width"),
    )


def layout_lines(spark, d):
    return L.lines(_glyphs(spark, d)).select("file_hash", "seq", "str", "x_s", "x_e")


def layout_paragraphs(spark, d):
    return L.paragraphs(_glyphs(spark, d)).select("file_hash", "seq", "text", F.col("n_lines").cast("long").alias("n_lines"))


def content_hashes(spark, d):
    c = F.encode("text", "UTF-8")
    return read(spark, d, "documents").select("doc_id", content_hash(c).alias("sha256"), content_hash(c, "SHA1").alias("sha1"), content_hash(c, "MD5").alias("md5"))


def base64_roundtrip(spark, d):
    made = read(spark, d, "benchmark").select("item_id", "text", T.base64_text(F.encode("text", "UTF-8")).alias("encoded"))
    bare = F.translate(F.regexp_replace("encoded", "=+$", ""), "+/", "-_")
    return made.select("item_id", "encoded", F.decode(T.unbase64_text(bare), "UTF-8").alias("decoded"))


def bracket_balance(spark, d):
    """Texts with one of many signs each put after them; most make a text unbalanced, 〔 and ［ don't count."""
    signs = F.array(*map(F.lit, ("", "<", "“", "”“", "〔", "［", "【】", "》《", "(", "）（", "}", "]", "<>")))
    return read(spark, d, "documents").select("doc_id", T.brackets_balanced(F.concat("text", F.element_at(signs, (F.col("doc_id") % 13 + 1).cast("int")))).alias("balanced"))


def duration_format(spark, d):
    return read(spark, d, "events").select("event_id", T.duration(F.floor(F.col("value") * 1_000_000).cast("long")).alias("duration"))


def percent_format(spark, d):
    return read(spark, d, "orders").select("o_orderkey", T.percent(F.col("o_orderkey") % 1000, F.lit(1000)).alias("percent"))


def url_basename(spark, d):
    return read(spark, d, "pages").select("page_id", T.basename(F.col("url")).alias("name"))


def utf16_lengths(spark, d):
    return read(spark, d, "documents").select("doc_id", T.utf16_length(F.col("text")).cast("long").alias("units"))


def half_width(spark, d):
    """Texts with a few full-width signs and letters before them."""
    return read(spark, d, "benchmark").select("item_id", T.halfwidth(F.concat(F.lit("（Ｎｏ．１～９）！　｟"), "text")).alias("text"))


def group_results(spark, d):
    rows = read(spark, d, "events").select(F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string")).alias("groupid"), "event_id")
    return group_rows(rows, "groupid", "event_id").select("groupid", "grouped", F.array_join(F.transform("items", lambda x: x["event_id"].cast("string")), ",").alias("ids"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        sentences, char_vector, min_length, length_ratio_pairs, cosine_pairs, text_join, text_join_cosine, exclusion, exclusion_diff, document_pairs,
        metadata_compare, average_hash, hash_similarity, image_pairs, entity_patterns, entity_conditions, entity_rules, entity_runs, layout_lines, layout_paragraphs,
        content_hashes, base64_roundtrip, bracket_balance, duration_format, percent_format, url_basename, utf16_lengths, half_width, group_results,
    )
}

# ---- SQL

# What stands here is written by itself: no constant is taken from the operators.

_SPACE = r"[\x{9}-\x{D} \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_ENDS = r"!?;\x{3002}\x{FF01}\x{FF1F}\x{FF1B}\x{203C}\x{203D}\x{2047}-\x{2049}"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_sentences(table: str, key: str, name: str) -> str:
    clean = f"trim(regexp_replace(array_to_string(list_transform(string_split(l, ''), lambda c: CASE WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) ELSE c END), ''), {_q(_SPACE)}, ' ', 'g'))"
    return f"""{name} AS MATERIALIZED (
  SELECT {key}, page, CAST(row_number() OVER (PARTITION BY {key} ORDER BY page, k) - 1 AS INTEGER) AS ord, text FROM (
    SELECT {key}, page, v.k, v.text FROM (
      SELECT {key}, CAST(u.line AS INTEGER) AS page, regexp_extract_all({clean}, {_q(f'[^{_ENDS}]+(?:[{_ENDS}]|$)')}) AS found
      FROM {table}, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(l, line)
    ), unnest(found) WITH ORDINALITY AS v(text, k) WHERE v.text <> ''))"""


_DOC, _ITEM = _sql_sentences("documents", "doc_id", "sd"), _sql_sentences("benchmark", "item_id", "sb")
_PAIRS = f"""da AS MATERIALIZED (SELECT DISTINCT text AS a_text FROM sd WHERE length(text) >= {MIN_LENGTH}),
db AS MATERIALIZED (SELECT DISTINCT text AS b_text FROM sb WHERE length(text) >= {{least}}),
pairs AS MATERIALIZED (SELECT a_text, b_text FROM da, db WHERE length(a_text)::DOUBLE / length(b_text)::DOUBLE BETWEEN {{t}}::DOUBLE AND 2.0::DOUBLE - {{t}}::DOUBLE),
ca AS MATERIALIZED (SELECT a_text, c, count(*) AS n FROM (SELECT a_text, unnest(string_split(a_text, '')) AS c FROM da) GROUP BY ALL),
cb AS MATERIALIZED (SELECT b_text, c, count(*) AS n FROM (SELECT b_text, unnest(string_split(b_text, '')) AS c FROM db) GROUP BY ALL),
na AS (SELECT a_text, sum(n * n)::DOUBLE AS q FROM ca GROUP BY ALL), nb AS (SELECT b_text, sum(n * n)::DOUBLE AS q FROM cb GROUP BY ALL),
dots AS (SELECT a_text, b_text, sum(ca.n * cb.n)::DOUBLE AS dot FROM ca JOIN cb USING (c) GROUP BY ALL),
cos AS MATERIALIZED (SELECT p.a_text, p.b_text, coalesce(dot, 0) / (sqrt(na.q) * sqrt(nb.q)) AS cosine FROM pairs p JOIN na USING (a_text) JOIN nb USING (b_text) LEFT JOIN dots USING (a_text, b_text))"""


def _pairs_sql(t: float, least: int = MIN_LENGTH) -> str:
    return f"WITH {_DOC}, {_ITEM}, " + _PAIRS.format(t=t, least=least)


_HASHED = """hashed AS MATERIALIZED (SELECT vec_id, string_agg(CASE WHEN v::DOUBLE > m THEN '1' ELSE '0' END, '' ORDER BY k) AS h FROM (
  SELECT vec_id, u.v, u.k, (SELECT list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding)) AS m FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(v, k)) GROUP BY vec_id)"""
_SIMILAR = "list_sum(list_transform(range(1, 65), lambda k: CASE WHEN substr({a}, k, 1) = substr({b}, k, 1) THEN 1 ELSE 0 END))::DOUBLE / 64"
_WORDS = """SELECT *, CASE WHEN regexp_matches(word, '^[0-9]+$') THEN 'm' WHEN NOT regexp_matches(word, '^\\p{{L}}+$') THEN 'x' WHEN regexp_matches(word, '^\\p{{Lu}}') THEN 'nr' WHEN length(word) >= 5 THEN 'n' ELSE 'v' END AS tag FROM (
  SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY k) - 1 AS INTEGER) AS idx, word FROM (SELECT {key} AS key, u.word, u.k FROM {table}, unnest(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+')) WITH ORDINALITY AS u(word, k)) WHERE word <> '')"""


_CODES = "0-9A-HJ-NPQRTUWXY"
_WRITTEN = {
    "time": "[0-9]{4} *[-/年] *[0-9]{1,2} *[-/月] *[0-9]{1,2} *日?",
    "tel": "[(（]0[0-9]{2,3}[)）][0-9]{7,8}|0[0-9]{2,3}[-－][0-9]{7,8}",
    "ucc": f"[{_CODES}]{{2}}[0-9]{{6}}[{_CODES}]{{10}}",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "idcard": "[1-9][0-9]{5}(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]",
    "domain": "https?://(?:[-A-Za-z0-9_.]|%[0-9A-Fa-f]{2})+",
    "paper": "《[^《》]+》",
}


def _found_by_pattern(key: str) -> str:
    one = [f"SELECT {key}, '{name}' AS type, unnest(regexp_extract_all(text, {_q(pattern)})) AS entity FROM t" for name, pattern in _WRITTEN.items()]
    return f"SELECT * FROM ({' UNION ALL '.join(one)}) WHERE type <> 'ucc' OR regexp_matches(entity, '[A-Z]')"


def _patterns_sql() -> str:
    return f"""WITH t AS (SELECT 'd' || doc_id AS key, text FROM documents UNION ALL SELECT 'p' || page_id, url || ' ' || html FROM pages), found AS ({_found_by_pattern('key')})
SELECT key, entity, type, CAST(count(*) AS INTEGER) AS num FROM found GROUP BY ALL"""


_NO_PART = r"""[.。,，!！?？;；:：\[\]［］{}"'“”‘’<>《》〔〕【】+\-*/=、\\$￥%^&…_\n\t ]"""
_BALANCED = " AND ".join(f"length(replace(entity, '{a}', '')) = length(replace(entity, '{b}', ''))" for a, b in ("()", "（）", "【】", "[]", "{}", "<>", "《》", "“”"))
_MANY = "an c eng f j l m n ns nt nz p v vn x"
_RUNS_SQL = {  # type: ends, tags, what is cut at the left, what holds of the whole
    "location": (
        "(国|省|市|区|县|乡|镇|村|屯|街道|路|街|巷|号|栋|座|楼|层|室|大厦|侧)$", "a b f m n ns nt nz x q v vn", "tag IN ('a', 'v', 'n', 'nt', 'm', 'q', 'b') OR NOT regexp_matches(word, '^[一-龥]')",
        f"CASE WHEN entity LIKE '%国' THEN length(entity) >= 2 ELSE length(entity) >= 3 AND NOT regexp_matches(entity, '(单号|编号|证号|账号|帐号|公众号|服务号|序号|序列号|版本号|手机号|型号|证书号|专区|农村|地区|作业区|每层|回填层|井室|一侧|一座|道路|上路|线路|分层|图层)$|^(教学楼|办公室|储藏室|试验室|会议室|办公区)$') AND {_BALANCED} END",
    ),
    "organization": (
        "(公司|中心|局|厅|部门|集团|政府|院|所|银行|支行|分行|典当行|合作社|学社|俱乐部|基地|园区|协会|商会|学会|工会|基金会|十字会|委员会|工作室|联盟|工厂|农场|牧场|渔场|矿场|电站|办公室|幼儿园|小学|中学|大学|学院|医院|办|办事处)$", _MANY,
        "word NOT IN ('全国', '国家') AND (tag IN ('c', 'f', 'v', 'vn', 'm', 'n', 'p') OR NOT regexp_matches(word, '^[一-龥]'))", f"length(entity) >= 6 AND entity NOT LIKE '%场所' AND {_BALANCED}",
    ),
    "system": (
        "(平台|系统|网|网站)$", _MANY, r"word NOT IN ('全国', '国家') AND (tag IN ('c', 'f', 'v', 'vn', 'm', 'n', 'p') OR regexp_matches(word, '^[()（）\d]'))",
        f"length(entity) >= 6 AND NOT regexp_matches(entity, '(互联网|管网|路网|上网|新风系统)$') AND {_BALANCED}",
    ),
}


def _runs_sql(type_: str, ends: str, tags: str, cut: str, valid: str) -> str:
    return f"""{type_} AS (
  SELECT * FROM (
    SELECT item_id, '{type_}' AS type, string_agg(word, '' ORDER BY idx) AS entity FROM (
      SELECT *, coalesce(min(CASE WHEN NOT ({cut}) THEN idx END) OVER (PARTITION BY item_id, run), max(idx) OVER (PARTITION BY item_id, run)) AS start FROM (
        SELECT *, sum(CASE WHEN part THEN 0 ELSE 1 END) OVER (PARTITION BY item_id ORDER BY idx) AS run FROM (
          SELECT a.*, ok AND EXISTS (SELECT 1 FROM m AS e WHERE e.item_id = a.item_id AND e.idx BETWEEN a.idx AND a.idx + 19 AND regexp_matches(e.word, {_q(ends)})
            AND NOT EXISTS (SELECT 1 FROM m AS x WHERE x.item_id = a.item_id AND x.idx BETWEEN a.idx AND e.idx AND NOT (x.tag IN ({', '.join(map(_q, tags.split()))}) AND NOT x.sign))) AS part
          FROM (SELECT *, tag IN ({', '.join(map(_q, tags.split()))}) AND NOT sign AS ok FROM m) a)
      ) WHERE part
    ) WHERE idx >= start GROUP BY item_id, run
  ) WHERE {valid}
)"""


def _rules_sql() -> str:
    fill = lambda c: f"replace(replace(replace(replace(replace(replace({c}, '{{k}}', CAST(item_id AS VARCHAR)), '{{k3}}', lpad(CAST(item_id % 1000 AS VARCHAR), 3, '0')), '{{k4}}', lpad(CAST(item_id % 10000 AS VARCHAR), 4, '0')), '{{k8}}', lpad(CAST(item_id AS VARCHAR), 8, '1')), '{{day}}', CAST(item_id % 28 + 1 AS VARCHAR)), '{{many}}', repeat('甲/ns ', item_id % 23) || '县/ns 。/x')"
    return f"""WITH t AS (SELECT item_id, {fill(_q(WRITTEN))} AS text, string_split({fill(f"[{', '.join(map(_q, TAGGED))}][item_id % {len(TAGGED)} + 1]")}, ' ') AS w FROM benchmark),
m AS (SELECT item_id, CAST(u.k AS INTEGER) AS idx, regexp_extract(u.x, '^(.*)/([a-z]+)$', 1) AS word, regexp_extract(u.x, '^(.*)/([a-z]+)$', 2) AS tag, regexp_matches(regexp_extract(u.x, '^(.*)/([a-z]+)$', 1), {_q(_NO_PART)}) AS sign FROM t, unnest(w) WITH ORDINALITY AS u(x, k)),
{', '.join(_runs_sql(k, *v) for k, v in _RUNS_SQL.items())},
found AS (SELECT * FROM location UNION ALL SELECT * FROM organization UNION ALL SELECT * FROM system
  UNION ALL SELECT item_id, 'person', word FROM m WHERE length(word) BETWEEN 2 AND 10 AND (tag = 'nr' OR tag = 'x' AND regexp_matches(word, '^[王李欧]'))
  UNION ALL SELECT item_id, 'mobile', word FROM m WHERE length(word) = 11 AND tag = 'm' AND regexp_matches(word, '1[3-9][0-9]{{9}}')
  UNION ALL {_found_by_pattern('item_id')})
SELECT item_id, entity, type, CAST(count(*) AS INTEGER) AS num FROM found GROUP BY ALL"""


# The token diff: Myers' greedy algorithm, a row for each number of edits, then the way back.
_TOKEN = r"[0-9A-Za-z_\x{AA}\x{AD}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C6}\x{2C8}-\x{2D7}\x{2DE}-\x{2FF}\x{1E00}-\x{1EFF}]+|\S"
_RUN = "(list_position(list_append(list_transform(range(0, greatest(0, least(n - {x}, m - ({y})))), lambda q: ta[CAST({x} + q + 1 AS BIGINT)] <> tb[CAST({y} + q + 1 AS BIGINT)]), true), true) - 1)"


def _marked_sql(s: str) -> str:
    c = f"list_transform(range(0, len(t{s})), lambda i: list_contains(h{s}, i))"
    return f"""m{s} AS MATERIALIZED (SELECT id, array_to_string(list_transform(range(1, len(t{s}) + 1), lambda k: CASE WHEN c[k] AND NOT coalesce(c[k - 1], false) THEN '<b>' ELSE '' END || g{s}[k] || CASE WHEN NOT c[k] AND coalesce(c[k - 1], false) THEN '</b>' ELSE '' END || t{s}[k]), '')
    || regexp_extract({s}_text, '\\s*$') || CASE WHEN coalesce(c[len(c)], false) THEN '</b>' ELSE '' END AS marked,
  coalesce(list_sum(list_transform(range(1, len(t{s}) + 1), lambda k: CASE WHEN c[k] OR coalesce(c[k - 1], false) THEN length(g{s}[k]) ELSE 0 END)), 0) + CASE WHEN coalesce(c[len(c)], false) THEN length(regexp_extract({s}_text, '\\s*$')) ELSE 0 END AS space,
  coalesce(list_sum(list_transform(range(1, len(t{s}) + 1), lambda k: CASE WHEN c[k] THEN length(t{s}[k]) ELSE 0 END)), 0) AS common FROM (SELECT *, {c} AS c FROM hits))"""


def _diff_sql(t: float, least: int) -> str:
    bag = lambda s: f"k{s} AS MATERIALIZED (SELECT {s}_text, tok, count(*) AS n FROM (SELECT {s}_text, unnest(regexp_extract_all({s}_text, {_q(_TOKEN)})) AS tok FROM d{s}) GROUP BY ALL)"
    back = "coalesce(i = 0 OR (i < d AND p[i] < p[i + 1]), false)"
    return _pairs_sql(t, least).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
near AS MATERIALIZED (SELECT a_text, b_text FROM cos WHERE cosine >= {t}::DOUBLE),
{bag('a')}, {bag('b')},
bags AS (SELECT a_text, b_text, sum(least(ka.n, kb.n) * length(tok)) AS common FROM near JOIN ka USING (a_text) JOIN kb USING (b_text, tok) GROUP BY ALL),
job AS MATERIALIZED (SELECT row_number() OVER () AS id, *, len(ta) AS n, len(tb) AS m FROM (
  SELECT a_text, b_text, regexp_extract_all(a_text, {_q(f'({_SPACE[:-1]}*)({_TOKEN})')}, 2) AS ta, regexp_extract_all(b_text, {_q(f'({_SPACE[:-1]}*)({_TOKEN})')}, 2) AS tb,
    regexp_extract_all(a_text, {_q(f'({_SPACE[:-1]}*)({_TOKEN})')}, 1) AS ga, regexp_extract_all(b_text, {_q(f'({_SPACE[:-1]}*)({_TOKEN})')}, 1) AS gb
  FROM bags WHERE common + least(length(a_text) - length(regexp_replace(a_text, '\\s', '', 'g')), length(b_text) - length(regexp_replace(b_text, '\\s', '', 'g'))) >= {t}::DOUBLE * greatest(length(a_text), length(b_text)) - 1e-6)),
reach AS (
  SELECT id, CAST(0 AS BIGINT) AS d, [CAST({_RUN.format(x='0', y='0')} AS BIGINT)] AS v FROM job
  UNION ALL
  SELECT id, d + 1, list_transform(list_transform(range(0, d + 2), lambda i: {{'k': 2 * i - d - 1, 'x': CASE WHEN i = 0 OR (i < d + 1 AND v[i] < v[i + 1]) THEN v[i + 1] ELSE v[i] + 1 END}}), lambda s: CAST(s.x + {_RUN.format(x='s.x', y='s.x - s.k')} AS BIGINT))
  FROM reach JOIN job USING (id) WHERE NOT coalesce(abs(n - m) <= d AND (n - m + d) % 2 = 0 AND v[CAST((n - m + d) // 2 AS BIGINT) + 1] >= n, false)
),
last AS (SELECT id, max(d) AS d FROM reach GROUP BY id),
way AS (
  SELECT id, d, n AS x, m AS y, CAST(NULL AS BIGINT) AS low, CAST(NULL AS BIGINT) AS high, CAST(NULL AS BIGINT) AS diagonal FROM last JOIN job USING (id)
  UNION ALL
  SELECT id, d - 1, px, py, CASE WHEN down OR d = 0 THEN px ELSE px + 1 END, x, x - y FROM (
    SELECT *, CASE WHEN d = 0 THEN 0 WHEN down THEN p[i + 1] ELSE p[i] END AS px, CASE WHEN d = 0 THEN 0 WHEN down THEN p[i + 1] - (x - y + 1) ELSE p[i] - (x - y - 1) END AS py FROM (
      SELECT *, {back} AS down FROM (SELECT w.id, w.d, w.x, w.y, CAST((w.x - w.y + w.d) // 2 AS BIGINT) AS i, r.v AS p FROM way w LEFT JOIN reach r ON r.id = w.id AND r.d = w.d - 1 WHERE w.d >= 0)))
),
common AS (SELECT id, unnest(range(low, high)) AS i, diagonal FROM way WHERE low < high),
hits AS MATERIALIZED (SELECT job.*, coalesce(ha, []) AS ha, coalesce(hb, []) AS hb FROM job LEFT JOIN (SELECT id, list(i) AS ha, list(i - diagonal) AS hb FROM common GROUP BY id) USING (id)),
{_marked_sql('a')}, {_marked_sql('b')},
alike AS (SELECT * FROM (SELECT a_text, b_text, (mb.common + least(ma.space, mb.space))::DOUBLE / greatest(length(a_text), length(b_text))::DOUBLE AS similarity, ma.marked AS a_marked, mb.marked AS b_marked FROM job JOIN ma USING (id) JOIN mb USING (id)) WHERE similarity >= {t}::DOUBLE)"""


_LINES = """g AS (
  SELECT l_orderkey AS file_hash, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS seq, l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR) AS str, CASE WHEN l_partkey % 5 = 0 THEN 14.0::DOUBLE ELSE 10.0::DOUBLE END AS height,
    CAST(l_suppkey % 60 + 60 AS DOUBLE) AS width, CAST(l_linenumber * 95 + l_partkey % 9 AS DOUBLE) AS x, CAST(700 - floor(l_linenumber / 3) * 15 AS DOUBLE) AS y FROM lineitem
), f AS (
  SELECT *, sum(CASE WHEN height IS NOT DISTINCT FROM ph THEN 0 ELSE 1 END) OVER (PARTITION BY file_hash ORDER BY seq) AS grp FROM (SELECT *, lag(height) OVER (PARTITION BY file_hash ORDER BY seq) AS ph FROM g)
), s AS (
  SELECT *, sum(CASE WHEN y = py AND abs(px + pw - x) < height THEN 0 ELSE 1 END) OVER (PARTITION BY file_hash, grp ORDER BY seq) AS line FROM (
    SELECT *, lag(y) OVER w AS py, lag(x) OVER w AS px, lag(width) OVER w AS pw FROM f WINDOW w AS (PARTITION BY file_hash, grp ORDER BY seq))
), lines AS (
  SELECT file_hash, grp, min(seq) AS seq, string_agg(str, '' ORDER BY seq) AS str, max(height) AS height, arg_min(x, seq) AS x_s, arg_min(x, seq) + sum(width) AS x_e FROM s GROUP BY file_hash, grp, line
)"""

ORACLE_SQL: dict[str, str] = {
    "sentences": f"WITH {_DOC} SELECT doc_id, page, ord, text FROM sd",
    "char_vector": f"WITH {_ITEM} SELECT item_id, ord, ch, CAST(count(*) AS INTEGER) AS n FROM (SELECT item_id, ord, unnest(CASE WHEN unicode(c) < 65536 THEN [c] ELSE [to_hex(55296 + (unicode(c) - 65536) // 1024), to_hex(56320 + (unicode(c) - 65536) % 1024)] END) AS ch FROM (SELECT item_id, ord, unnest(string_split(text || CASE WHEN ord % 2 = 0 THEN '😀中😃' ELSE '' END, '')) AS c FROM sb)) GROUP BY ALL",
    "min_length": f"WITH {_DOC} SELECT doc_id, count(*) AS n_sentences FROM sd WHERE length(text) >= {MIN_LENGTH} GROUP BY doc_id",
    "length_ratio_pairs": _pairs_sql(RATIO) + " SELECT b_text, count(*) AS n_pairs, CAST(sum(length(a_text)) AS BIGINT) AS sum_len FROM pairs GROUP BY b_text",
    "cosine_pairs": _pairs_sql(RATIO) + f" SELECT b_text, count(*) AS n_pairs, round(max(cosine), 9) AS best FROM cos WHERE cosine >= {RATIO}::DOUBLE GROUP BY b_text",
    "text_join": _diff_sql(RATIO, MIN_LENGTH) + " SELECT sd.doc_id, sd.ord AS doc_ord, sb.item_id, sb.ord AS item_ord, similarity, a_marked, b_marked FROM alike JOIN sd ON sd.text = a_text JOIN sb ON sb.text = b_text",
    "exclusion_diff": _diff_sql(CLOSE, 0) + " SELECT doc_id, page, text, min(ord) AS ord FROM sd WHERE text IN (SELECT a_text FROM pairs) AND text NOT IN (SELECT a_text FROM alike) GROUP BY doc_id, page, text",
    "text_join_cosine": _pairs_sql(CLOSE) + f" SELECT sd.doc_id, sd.ord AS doc_ord, sb.item_id, sb.ord AS item_ord, round(cosine, 9) AS similarity FROM cos JOIN sd ON sd.text = a_text JOIN sb ON sb.text = b_text WHERE cosine >= {CLOSE}::DOUBLE",
    "exclusion": _pairs_sql(CLOSE, 0) + f", judged AS (SELECT a_text, bool_or(cosine >= {CLOSE}::DOUBLE) AS hit FROM cos GROUP BY a_text) SELECT doc_id, page, text, min(ord) AS ord FROM sd JOIN judged ON a_text = text WHERE NOT hit GROUP BY doc_id, page, text",
    "document_pairs": "WITH d AS (SELECT item_id AS ord, 'item-' || item_id AS name, sha256(text) AS h FROM benchmark) SELECT sha256(l.h || ':' || r.h || ':' || l.ord || ':' || r.ord) AS pair_id, l.ord AS i, r.ord AS j, l.h AS hash_l, r.h AS hash_r, l.name AS name_l, r.name AS name_r FROM d l JOIN d r ON l.ord < r.ord",
    "metadata_compare": "WITH p AS (SELECT l.doc_id AS i, r.doc_id AS j, l.lang AS la, r.lang AS lb, CAST(l.n_chars AS VARCHAR) AS na, CAST(r.n_chars AS VARCHAR) AS nb FROM documents l JOIN documents r ON l.source = r.source AND l.doc_id < r.doc_id)"
    " SELECT i, j, 'language' AS label, la AS a, lb AS b, la IS NOT DISTINCT FROM lb AS same FROM p UNION ALL SELECT i, j, 'size', na, nb, na IS NOT DISTINCT FROM nb FROM p UNION ALL SELECT i, j, 'author', NULL, NULL, true FROM p",
    "average_hash": f"WITH {_HASHED} SELECT vec_id, h AS image_hash FROM hashed",
    "hash_similarity": f"WITH {_HASHED} SELECT l.vec_id, {_SIMILAR.format(a='l.h', b='r.h')} AS similarity FROM hashed l JOIN hashed r ON r.vec_id = l.vec_id + 1",
    "image_pairs": f"WITH {_HASHED}, i AS (SELECT vec_id, h, 90 + vec_id % 7 * 10 AS w, 95 + vec_id % 5 * 10 AS t FROM hashed), p AS (SELECT l.vec_id AS a, r.vec_id AS b, {_SIMILAR.format(a='l.h', b='r.h')} AS similarity FROM i l JOIN i r ON l.vec_id < r.vec_id"
    f" WHERE least(l.w, l.t, r.w, r.t) >= 100 AND (l.t::DOUBLE / l.w) / (r.t::DOUBLE / r.w) BETWEEN {IMAGE}::DOUBLE AND 2.0::DOUBLE - {IMAGE}::DOUBLE) SELECT * FROM p WHERE similarity > {IMAGE}::DOUBLE",
    "entity_patterns": _patterns_sql(),
    "entity_conditions": f"WITH t AS ({_WORDS.format(key=chr(39).join(['conv_id || ', ':', ' || turn']), table='conversations')}), found AS (SELECT key, 'person' AS type, word AS entity FROM t WHERE length(word) BETWEEN 2 AND 10 AND (tag = 'nr' OR tag = 'x' AND regexp_matches(word, '^[王李张刘陈欧]'))"
    " UNION ALL SELECT key, 'mobile', word FROM t WHERE length(word) = 11 AND tag = 'm' AND regexp_matches(word, '1[3-9][0-9]{9}')) SELECT key, entity, type, CAST(count(*) AS INTEGER) AS num FROM found GROUP BY ALL",
    "entity_rules": _rules_sql(),
    "entity_runs": f"""WITH t AS ({_WORDS.format(key='doc_id', table='documents')}), m AS (
  SELECT *, tag IN ('n', 'nr', 'v') AND NOT regexp_matches(word, {_q(_NO_PART)}) AS ok, regexp_matches(word, '(tion|ing)$') AS ends FROM t
), a AS (
  SELECT *, min(CASE WHEN ends THEN idx END) OVER w AS nxt, min(CASE WHEN NOT ok THEN idx END) OVER w AS bad FROM m WINDOW w AS (PARTITION BY key ORDER BY idx ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), p AS (
  SELECT *, ok AND nxt IS NOT NULL AND (bad IS NULL OR bad > nxt) AS part FROM a
), r AS (
  SELECT *, sum(CASE WHEN part THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY idx) AS run FROM p
), c AS (
  SELECT key, run, min(idx) AS at, coalesce(min(CASE WHEN tag <> 'v' THEN idx END), max(idx)) AS start FROM r WHERE part GROUP BY key, run
)
SELECT key AS doc_id, c.at, string_agg(word, '' ORDER BY idx) AS entity FROM r JOIN c USING (key, run) WHERE part AND idx >= c.start GROUP BY key, run, c.at HAVING length(string_agg(word, '')) >= 6""",
    "layout_lines": f"WITH {_LINES} SELECT file_hash, seq, str, x_s, x_e FROM lines",
    "layout_paragraphs": f"""WITH {_LINES}, q AS (
  SELECT *, sum(CASE WHEN abs(pe + ps - 600.0::DOUBLE) < 2 * height + 10 THEN 0 ELSE 1 END) OVER (PARTITION BY file_hash, grp ORDER BY seq) AS para FROM (SELECT *, lag(x_e) OVER w AS pe, lag(x_s) OVER w AS ps FROM lines WINDOW w AS (PARTITION BY file_hash, grp ORDER BY seq))
) SELECT file_hash, min(seq) AS seq, string_agg(str, '' ORDER BY seq) AS text, count(*) AS n_lines FROM q GROUP BY file_hash, grp, para""",
    "content_hashes": "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5 FROM documents",
    "base64_roundtrip": "SELECT item_id, base64(encode(text)) AS encoded, text AS decoded FROM benchmark",
    "bracket_balance": f"SELECT doc_id, {_BALANCED} AS balanced FROM (SELECT doc_id, text || ['', '<', '“', '”“', '〔', '［', '【】', '》《', '(', '）（', '}}', ']', '<>'][doc_id % 13 + 1] AS entity FROM documents)",
    "duration_format": "SELECT event_id, concat(CASE WHEN s // 86400 > 0 THEN (s // 86400) || '天' ELSE '' END, CASE WHEN s % 86400 // 3600 > 0 THEN (s % 86400 // 3600) || '小时' ELSE '' END, CASE WHEN s % 3600 // 60 > 0 THEN (s % 3600 // 60) || '分钟' ELSE '' END, s % 60, '秒') AS duration FROM (SELECT event_id, CAST(floor(floor(value * 1000000) / 1000) AS BIGINT) AS s FROM events)",
    "percent_format": "SELECT o_orderkey, printf('%.4f', (o_orderkey % 1000)::DOUBLE / 1000) AS percent FROM orders",
    "url_basename": "SELECT page_id, string_split(url, '/')[-1] AS name FROM pages",
    "utf16_lengths": "SELECT doc_id, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS units FROM documents",
    "half_width": "SELECT item_id, '(No.1~9)!　｟' || text AS text FROM benchmark",
    "group_results": "SELECT CAST(user_id AS VARCHAR) AS groupid, true AS grouped, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events WHERE user_id % 10 <> 0 GROUP BY user_id UNION ALL SELECT NULL, false, CAST(event_id AS VARCHAR) FROM events WHERE user_id % 10 = 0 OR user_id IS NULL",
}
