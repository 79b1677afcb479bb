"""Typed entities from text: by pattern, by a condition on tagged words, and by runs of tagged words.

Rules are values; their parts are expressions of Spark's own. Within a text the order is that of the
rules, then of appearance. Rules may overlap: one string can be an entity of several types.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Characters that are never inside an entity. Those beyond Latin-1 aren't in the pattern: tasks side by side contend for a class of such.
PUNCTUATION = r"[\s" + "".join("\\" + c for c in sorted("$%&*+,-./:;<=>?[]^_{}!\"'\\")) + "]"
WIDE_PUNCTUATION = "。，！？；：［］“”‘’《》〔〕【】、￥…"
SURNAMES = "丁万东严丰乌乐乔乜习于云井仇从仰仲任伊伍伏何余侯俞倪傅储僪元充党全公关养冀冉农冯冷凌凤刁刘利别劳勾包匡华卓单卜卞卢卫印危却厉厍双古史叶司吉后向吕吴周和咸唐喻国堵夏夔奚姚姜姬娄孔孙孟季宁安宋宓宗宣宦宫宰家容宿寇富寿封尉尚尤尹居屈屠山岑崔嵇巢左巩巫巴师席常干平幸广庄应庞康庾廉廖弓弘张强彭徐怀惠慎慕戈戎成戚戴房扈扶支敖文方於施时昌明易昝晁晏景暨暴曹曾朱权李杜束杨杭松林柏查柯柳柴栾桂桑桓梁梅樊欧步武殳段殷毋毕毛水江池汤汪汲沃沈沙洪浦温游湛溥滑滕满潘濮焦熊燕牛牧狄王班璩甄甘田申白皮益盍盛相瞿石祁祖祝禄禹秋秦程穆空窦章童竺符简管籍米糜索红纪终经缪罗羊羿翁翟耿聂胡胥能臧舒艾芮花苍苏苗范茅茹荀荆荣莘莫萧葛董蒋蒙蒯蒲蓝蓟蓬蔚蔡蔺薛虞融衡袁裘裴褚解訾詹计许诸谈谢谭谷贝贡贲费贺贾赖赵越路车辛边连逄通逮邓邢那邬邰邱邴邵邹郁郎郑郗郜郝郦郭都鄂酆金钟钭钮钱闵闻阎阙阚阮阴陆陈陶隆隗雍雷霍靳鞠韦韩韶项须顾颜饶马骆高鬱魏鱼鲁鲍麴麻黄黎齐龙龚"
_BAR = "|".join
DIGITS = "[0-9]"
_CODE = "[" + "".join(c for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in "IOSVZ") + "]"
_CODE_LETTER = "[" + "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in "IOSVZ") + "]"


def _date(*separators: str) -> str:
    return f"{DIGITS}{{4}} *({separators[0]}) *{DIGITS}{{1,2}} *({separators[1]}) *{DIGITS}{{1,2}} *({separators[2]})?"


def _phone() -> str:
    area, number = f"0{DIGITS}{{2,3}}", f"{DIGITS}{{7,8}}"
    return f"([(（]{area}[)）]{number})|({area}[-－]{number})"


def _identity() -> str:
    year, month, day = f"(?:19|20){DIGITS}{{2}}", _BAR((f"(?:0[1-9]", "1[0-2])")), _BAR(("(?:0[1-9]", f"[12]{DIGITS}", "3[01])"))
    return f"[1-9]{DIGITS}{{5}}{year}{month}{day}{DIGITS}{{3}}[0-9xX]"


PATTERNS: dict[str, str] = {
    "time": _date("[-/年]", "[-/月]", "日"),
    "tel": _phone(),
    "ucc": f"{_CODE}{{2}}{DIGITS}{{6}}{_CODE}{{10}}",
    "email": "[A-Za-z0-9%+._-]+@" + "[A-Za-z0-9.-]+" + "[.][A-Za-z]{2,}",
    "idcard": _identity(),
    "domain": "https?://(?:[0-9A-Za-z_.-]|%[0-9A-Fa-f]{2})+",
    "paper": "《[^《》]+》",
}
#: A further condition on what a pattern finds.
CHECKS: dict[str, str] = {"ucc": _CODE_LETTER}


@dataclass(frozen=True)
class RunRule:
    """Runs of words that may be part of an entity, each with a word that ends one at most `ahead` words on."""

    type: str
    ends: str
    tags: frozenset[str]
    cut_tags: frozenset[str]
    cut_word: str = ""
    never_cut: frozenset[str] = frozenset()
    right_tags: frozenset[str] = frozenset()
    right_word: str = ""
    valid: Callable[[Column], Column] = field(default=lambda e: F.lit(True))
    ahead: int = 20


def _ends(words: str) -> str:
    return f"({_BAR(sorted(words.split(), key=lambda w: (-len(w), w)))})$"


def _location(e: Column) -> Column:
    no = _ends("编号 单号 证号 账号 帐号 序号 型号 公众号 服务号 序列号 版本号 手机号 证书号 专区 农村 地区 作业区 每层 分层 图层 回填层 井室 一侧 一座 道路 上路 线路")
    rooms = "^" + _ends("办公区 办公室 会议室 储藏室 试验室 教学楼")
    return F.when(e.rlike("国$"), T.utf16_length(e) >= 2).otherwise((T.utf16_length(e) >= 3) & ~e.rlike(no) & ~e.rlike(rooms) & T.brackets_balanced(e))


_NOT_HAN = "^[^一-龥]|^$"
_WIDE = frozenset("an c eng f j l m n ns nt nz p v vn x".split())
RUNS: tuple[RunRule, ...] = (
    RunRule("location", _ends("国 省 市 县 区 镇 乡 村 屯 路 街 巷 街道 号 栋 座 楼 层 室 侧 大厦"), frozenset("a b f m n ns nt nz q v vn x".split()), frozenset("a b m n nt q v".split()), _NOT_HAN, valid=_location),
    RunRule(
        "organization",
        _ends("局 厅 院 所 办 公司 集团 中心 部门 政府 办事处 办公室 委员会 银行 支行 分行 典当行 基金会 合作社 十字会 协会 商会 学会 工会 联盟 学社 俱乐部 工作室 基地 园区 工厂 农场 牧场 渔场 矿场 电站 大学 中学 小学 学院 医院 幼儿园"),
        _WIDE, frozenset("c f m n p v vn".split()), _NOT_HAN, frozenset(("国家", "全国")),
        valid=lambda e: (T.utf16_length(e) >= 6) & ~e.rlike("场所$") & T.brackets_balanced(e),
    ),
    RunRule(
        "system", _ends("系统 平台 网站 网"), _WIDE, frozenset("c f m n p v vn".split()), "^[()（）0-9]", frozenset(("国家", "全国")),
        valid=lambda e: (T.utf16_length(e) >= 6) & ~e.rlike(_ends("新风系统 互联网 管网 路网 上网")) & T.brackets_balanced(e),
    ),
)
#: Conditions on one tagged word.
CONDITIONS: dict[str, Callable[[Column, Column], Column]] = {
    "person": lambda word, tag: T.utf16_length(word).between(2, 10) & ((tag == "nr") | ((tag == "x") & word.rlike(f"^[{SURNAMES}]"))),
    "mobile": lambda word, tag: (T.utf16_length(word) == 11) & (tag == "m") & word.rlike(f"1[3-9]{DIGITS}{{9}}"),
}
ORDER = ("location", "organization", "system", "person", "time", "mobile", "tel", "ucc", "email", "idcard", "domain", "paper")


def by_pattern(df: DataFrame, key: str, text: str, types: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """key, type, at, entity: whole matches of each pattern, in order. The text is read once for all patterns."""

    def found(t: str) -> Column:
        all_ = F.regexp_extract_all(F.col(text), F.lit(PATTERNS[t]), F.lit(0))
        all_ = F.filter(all_, lambda e: e.rlike(CHECKS[t])) if t in CHECKS else all_
        return F.transform(all_, lambda e, i: F.struct(F.lit(t).alias("type"), i.alias("at"), e.alias("entity")))

    return df.select(key, F.inline(F.concat(*map(found, types))))


def by_condition(tokens: DataFrame, key: str, conditions: dict[str, Callable[[Column, Column], Column]] = CONDITIONS) -> DataFrame:
    """key, type, at, entity: words of tokens (key, idx, word, tag) that meet a condition."""
    kinds = F.array_compact(F.array(*[F.when(c(F.col("word"), F.col("tag")), F.lit(t)) for t, c in conditions.items()]))
    return tokens.select(key, F.explode(kinds).alias("type"), F.col("idx").alias("at"), F.col("word").alias("entity"))


def _punctuated(word: Column) -> Column:
    """Whether there is any of the characters that are never inside an entity."""
    wide = (F.octet_length(word) > F.length(word)) & (F.length(F.translate(word, WIDE_PUNCTUATION, "")) < F.length(word))
    return word.rlike(PUNCTUATION) | wide


def _cut(words: Column, sign: str) -> Column:
    """words from the first on that isn't marked; if all are, the last one."""
    first = F.array_position(F.transform(words, lambda x: x[sign]), False)
    return F.slice(words, F.when(first > 0, first.cast("int")).otherwise(F.size(words)), F.size(words))


def by_runs(tokens: DataFrame, key: str, rules: tuple[RunRule, ...] = RUNS) -> DataFrame:
    """key, type, at, entity from runs of tokens (key, idx, word, tag).

    A word is a part if its tag is right, it is no punctuation, a word that ends an entity comes within
    `ahead` words (itself included), and none in between is unfit. Runs of parts are entities: cut at
    the left, and then at the right, as long as words are of cut tags or look wrong (of words that all do
    one stays), then checked. All rules share one sort of the words.
    """
    # Backwards, so that what comes next is known from rows before: no row is looked at twice.
    w = Window.partitionBy(key).orderBy(F.col("idx").desc())
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    word, tag = F.col("word"), F.col("tag")
    fit = [F.coalesce(tag.isin(*sorted(r.tags)) & ~_punctuated(word), F.lit(False)) for r in rules]
    marked = tokens.select(key, "idx", "word", "tag", *[c.alias(f"ok{k}") for k, c in enumerate(fit)], *[F.coalesce(word.rlike(r.ends), F.lit(False)).alias(f"ends{k}") for k, r in enumerate(rules)])
    marked = marked.withColumn("__n", F.row_number().over(w))
    marked = marked.withColumns({f"next{k}": F.max(F.when(F.col(f"ends{k}"), F.col("__n"))).over(upto) for k in range(len(rules))} | {f"bad{k}": F.max(F.when(~F.col(f"ok{k}"), F.col("__n"))).over(upto) for k in range(len(rules))})
    soon = lambda k, r: F.coalesce(F.col("__n") - F.col(f"next{k}") < r.ahead, F.lit(False)) & (F.col(f"bad{k}").isNull() | (F.col(f"bad{k}") < F.col(f"next{k}")))
    marked = marked.withColumns({f"part{k}": F.col(f"ok{k}") & soon(k, r) for k, r in enumerate(rules)})
    marked = marked.withColumns({f"run{k}": F.sum((~F.col(f"part{k}")).cast("int")).over(upto) for k in range(len(rules))})

    def wrong(tags: frozenset[str], pattern: str, r: RunRule) -> Column:
        out = F.coalesce(tag.isin(*sorted(tags)), F.lit(False)) if tags else F.lit(False)
        out = out | word.rlike(pattern) if pattern else out
        return out & ~word.isin(*sorted(r.never_cut)) if r.never_cut else out

    each = F.array(*[F.when(F.col(f"part{k}"), F.struct(F.lit(k).alias("rule"), F.col(f"run{k}").alias("run"), wrong(r.cut_tags, r.cut_word, r).alias("left"), wrong(r.right_tags, r.right_word, r).alias("right"))) for k, r in enumerate(rules)])
    found = marked.select(key, "idx", "word", F.explode(F.array_compact(each)).alias("r")).select(key, "idx", "word", "r.*")
    runs = found.groupBy(key, "rule", "run").agg(F.min("idx").alias("at"), F.array_sort(F.collect_list(F.struct("idx", "word", "left", "right"))).alias("w"))
    kept = runs.select(key, "rule", "at", _cut(F.col("w"), "left").alias("w"))
    kept = kept.select(key, "rule", "at", F.reverse(_cut(F.reverse("w"), "right")).alias("w"))
    made = kept.select(key, "rule", "at", F.array_join(F.transform("w", lambda x: x["word"]), "").alias("entity"))
    type_, ok = F.lit(None).cast("string"), F.lit(False)
    for k, r in enumerate(rules):
        type_, ok = F.when(F.col("rule") == k, F.lit(r.type)).otherwise(type_), F.when(F.col("rule") == k, r.valid(F.col("entity"))).otherwise(ok)
    return made.where(ok).select(key, type_.alias("type"), "at", "entity")


def deduplicate(entities: DataFrame, keys: tuple[str, ...] = ("entity", "type"), num: str = "num", order: str | None = None) -> DataFrame:
    """One row for each key; num is how often it occurs (its own num summed), and stays as it is for what occurs once.

    With an order the smallest of each key stays, as that column."""
    has = num in entities.columns
    n = F.coalesce(F.col(num), F.lit(1)) if has else F.lit(1)
    first = [F.min(order).alias(order)] if order else []
    out = entities.groupBy(*keys).agg(F.sum(n).alias("__n"), F.count("*").alias("__c"), (F.first(num) if has else F.lit(None).cast("int")).alias("__f"), *first)
    return out.select(*keys, F.when(F.col("__c") > 1, F.col("__n")).otherwise(F.col("__f")).cast("int").alias(num), *([order] if order else []))


def extract(df: DataFrame, key: str, text: str = "text", tagger: Callable[[Column], Column] | None = None, tagged: str | None = None) -> DataFrame:
    """key, entity, type, num of every rule, and position: its rule's place in ORDER and its own within the rule. Words come from `tagged` (array of word and tag) or from a tagger; without either only patterns run."""
    found = by_pattern(df, key, text)
    words = F.col(tagged) if tagged else tagger(F.col(text)) if tagger else None
    if words is not None:
        tokens = df.select(key, F.posexplode(words).alias("idx", "t")).select(key, "idx", "t.word", "t.tag")
        found = found.unionByName(by_condition(tokens, key)).unionByName(by_runs(tokens, key))
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("type")).cast("int")
    found = found.withColumn("position", F.struct(place.alias("rule"), F.col("at").cast("int").alias("at")))
    return deduplicate(found, (key, "entity", "type"), order="position")
