"""Personal information in free text, by labelers whose reliabilities are estimated from their votes (problem 10)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.session import cut, free_name, spread

KINDS = ("name", "email", "phone", "id_number", "address")
#: Each labeler votes 1, -1, or 0 where it abstains.
LABELERS = ("regex", "structure", "gazetteer", "context", "against")
#: What the classifier sees of a span beside the votes: its form, and the classes of the characters on both sides. With the votes these make a
#: bounded number of patterns, whatever the data, and only their counts come to the driver.
FEATURES = ("shape", "before", "after")
#: Bits of the filter of learned names (2^23 bits, 1 MB), however many names there are.
NAME_BITS = 23

_WIDE = str.maketrans("０１２３４５６７８９＋－（）＠．　／", "0123456789+-()@. /")
# Frequent Chinese surnames, double surnames first.
SURNAMES_2 = "欧阳 司徒 上官 诸葛 司马 东方 独孤 南宫 夏侯 尉迟 皇甫 令狐 慕容 长孙 宇文 公孙 轩辕 端木 百里 呼延 澹台 申屠 太史 闻人 钟离 西门 东郭 第五".split()
SURNAMES_1 = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文温阮柏裴陶翁牛霍向纪安俞章鲁葛韦毕聂焦倪严华祝左童关辛管耿齐岳梅庄路涂詹季施骆成颜凌盛欧包单窦柳游翟闵卫卓路宁"
_SURNAME = f"(?:{'|'.join(SURNAMES_2)}|[{SURNAMES_1}])"
# What stands before or after a person's name.
ROLES = "联系人|负责人|经办人|审核员|评审员|投资者|董事会秘书|证券事务代表|法定代表人|收件人|登记人|证人|组长|经理|客户|股东|秘书|总监|主任|代表|姓名|签字人|申请人|当事人|委托人"
TITLES = "先生|女士|小姐|同志|教授|博士|老师"
_ZH_AFTER = f"(?:{TITLES}|签字|收(?=[。，；]|$)|担任|来信|来电|致电|任(?=[^务何意])|的办公地点|的住址|的电话|[（(][^）)]{{0,24}}\\d|，电话|，身份证|，住|、电话)"
# What persons do, right after their name.
_ZH_SPOKE = "到会|出席|发言|表示|指出|介绍|认为|说[，：]|称[，：]|回忆|告诉"
_ZH_NAMES = (
    re.compile(f"(?:{ROLES})[：:为是 ]{{0,2}}(?P<v>{_SURNAME}[一-鿿]{{1,2}}?)(?={_ZH_AFTER}|[，。；：、（）()\\s]|$)"),
    re.compile(f"由(?P<v>{_SURNAME}[一-鿿]{{1,2}}?)(?=担任|负责|主持|签字)"),
    re.compile(f"(?<![一-鿿])(?P<v>{_SURNAME}[一-鿿]{{1,2}}?)(?={TITLES}|签字|来信|致电)"),
    re.compile(f"(?P<v>{_SURNAME}[一-鿿]{{1,2}}?)(?={TITLES})"),
    re.compile(f"(?<![一-鿿])(?P<v>{_SURNAME}[一-鿿]{{2}})(?={_ZH_SPOKE})"),
)
_WORD = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:[-'’][A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)?"
_EN_NAMES = (
    re.compile(rf"\b(?:[Mm]y name is|[Ii] am|Herr|Frau|Monsieur|Madame|Señora?|Signora?) +(?P<v>{_WORD}(?: {_WORD}){{1,2}})"),
    re.compile(rf"\b(?:Mr|Mrs|Ms|Dr|Miss|Prof)\.? +(?P<v>{_WORD}(?: {_WORD}){{1,2}})"),
    re.compile(rf"\b(?:(?:[Ww]rite to|[Cc]ontact|[Aa]ttention|[Ss]igned by|[Rr]eleased by)[:：]?|[Ww]itness[,:：]|[Nn]ame[:：]) *(?<=[ :：])(?!(?:Mr|Mrs|Ms|Dr|Miss|Prof)\b)(?P<v>{_WORD}(?: {_WORD}){{1,2}})(?= at\b|,| \(|\.|;|[ \r]*(?:\n|$))"),
    re.compile(rf"\b(?P<v>{_WORD} {_WORD})(?= \(ID|, lives at|(?:,| \() ?(?:[Tt]el|[Pp]hone)\b)"),
)
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@| ?[(\[] ?at ?[)\]] ?| at (?=[a-z0-9.-]+\.(?:example|test|invalid|com|net|org|cn)\b))[A-Za-z0-9](?:[A-Za-z0-9-]|\.(?=[A-Za-z0-9]))*\.[A-Za-z]{2,}(?![A-Za-z0-9])", re.I)
_PHONE = re.compile(
    r"(?<![\dA-Za-z.\-+])(?:"
    r"(?:\+|00)\d{1,3}[ -]?(?:\(\d{2,4}\)[ -]?)?\d{2,4}(?:[ -]?\d{3,4}){1,3}"  # with country code
    r"|\(\d{3,4}\) ?\d{3,4}[ -]?\d{4}"  # area code in brackets
    r"|\(\d{3}\) ?\d{3}[ -]?\d{4}"
    r"|1[3-9]\d(?:[ -]?\d{4}){2}"  # mobile
    r"|0\d{2,3}[ -]\d{7,8}"  # area code and number
    r"|\d{3}[ -]\d{3}[ -]\d{4}|\d{3}-\d{4}"
    r"|0\d{2,4} \d{3,4} \d{3,4}"  # trunk code and two groups
    r"|(?:\+\d{1,3}[ .-])?(?:(?:\d{3}\.|\(\d{3}\)[ .]?)\d{3}\.\d{4}|1[3-9]\d\.\d{4}\.\d{4})(?!\.\d)"  # dotted
    r")(?![\d]|[A-Za-z]|-\d)"
)
_ID = re.compile(r"(?<![\dA-Za-z.\-])(?:[1-9]\d{5}[ -]?(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[ -]?\d{3}[\dXx]|[1-9]\d{5}[ -]?\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[ -]?\d{3}|\d{3}-\d{2}-\d{4})(?![\dA-Za-z]|-\d)")
_ZH_ADDRESS = re.compile(
    rf"(?:(?:(?P<p>[一-鿿]{{2,4}}?)(?:省|自治区))?(?:[一-鿿]{{2,4}}?市)?(?:[一-鿿]{{2,4}}?(?:区|县|镇|乡))?)"
    rf"(?P<road>[一-鿿]{{1,6}}?(?:大道|大街|胡同|路|街|巷|里|道|弄))(?P<no>\d+(?:-\d+)?号)"
    rf"(?P<detail>(?:[A-Za-z]座|[A-Za-z0-9一二三四五六七八九十]+(?:号楼|栋|幢|座|单元|层|楼|室|号房|房))*)"
)
# Words before an address that are no part of it.
_LEAD = re.compile("^.*?(?:办公地点在|地点为|地点在|地址为|地址是|地址|住址为|住址|住在|寄至|寄往|寄到|送至|送到|位于|设于|设在|居住于|现居|在|为|至|于|到|住|是|往)(?=[一-鿿]{2,4}?(?:省|自治区|市|区|县|路|街|巷|大道|里))")
_EN_ADDRESS = re.compile(rf"(?<![\w.,-])\d{{1,5}}[A-Z]? (?:{_WORD} ){{1,3}}(?:Road|Street|Lane|Avenue|Quay|Drive|Square|Terrace|Row|Way|Court|Close|Place|Boulevard|Hill|Walk)(?:, (?:Suite|Flat|Floor|Unit|Apt|Apartment|Room)\.? ?\w+)?(?:, {_WORD}(?: {_WORD})?)?")
# Words near a value that speak for its kind, and words that speak against any kind.
_FOR = {
    "phone": re.compile("电话|手机|拨打|致电|回拨|号码|联系|传真|phone|call|tel|mobile|审核员|raised", re.I),
    "id_number": re.compile("身份证|证件|identity|ID no|ID number|passport", re.I),
    "email": re.compile("邮箱|写信|发送|邮件|回复|mail|write|sent|reply", re.I),
    "address": re.compile("地点|地址|住址|寄|住|lives|kept at|to|office", re.I),
    "name": re.compile(f"{ROLES}|{TITLES}|由|Mr|Ms|Mrs|Dr|write to|witness|contact", re.I),
}
_AGAINST = re.compile("流水号|批次|编号|信用代码|样品|合同|订单|order|batch|certificate|invoice", re.I)


def _id_votes(digits: str) -> int:
    """+1 if the parts of an identity number are consistent (a real birth date that isn't in the future), else -1."""
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", digits):
        return 1
    d = re.sub(r"[ -]", "", digits)
    y, m, day = (d[6:10], d[10:12], d[12:14]) if len(d) == 18 else ("19" + d[6:8], d[8:10], d[10:12])
    try:
        return 1 if 1900 <= date(int(y), int(m), int(day)).year <= 2030 else -1
    except ValueError:
        return -1


def label_spans(text: str) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """(kind, start, end, votes) of every span that a labeler proposes; votes are 1, -1 or 0 (abstains).

    The labelers: regex (the form), structure (parts that must agree), gazetteer (surnames, kinds of roads; the
    corpus' own names are voted on later), context (words around that speak for the kind) and against (words
    before that speak for another kind of number).
    """
    s = text.translate(_WIDE) if _HAS_WIDE.search(text) else text
    spans: dict[tuple[str, int, int], list[int]] = {}

    def add(kind: str, a: int, b: int, regex: int = 1, structure: int = 0, gazetteer: int = 0) -> None:
        near = s[max(0, a - 18) : a] + "\n" + s[b : b + 8]
        before = s[max(0, a - 8) : a]
        context = 1 if _FOR[kind].search(near) else -1
        against = -1 if kind in ("phone", "id_number") and _AGAINST.search(before if _CJK.search(before) else s[max(0, a - 14) : a]) and not _FOR[kind].search(before) else 0
        spans.setdefault((kind, a, b), [regex, structure, gazetteer, context, against])

    has_digit = _DIGITS.search(s) is not None
    if "@" in s or "at" in s:
        for m in _EMAIL.finditer(s):
            add("email", *m.span(), structure=1 if re.search(r"\.[A-Za-z]{2,}$", m[0]) else -1)
    if has_digit:
        for m in _ID.finditer(s):
            add("id_number", *m.span(), structure=_id_votes(m[0]))
        for m in _PHONE.finditer(s):
            n = sum(c.isdigit() for c in m[0])
            add("phone", *m.span(), structure=1 if 7 <= n <= 15 else -1)
        if _NUMBERED.search(s):
            for m in _ZH_ADDRESS.finditer(s):
                a = m.start()
                if lead := _LEAD.match(s[a : m.end()]):
                    a += lead.end()
                road = m.start("road")
                places = s[a:road] if a < road else ""
                add("address", a, m.end(), structure=1 if re.search("[市省区县]", places) else -1, gazetteer=1)
        for m in _EN_ADDRESS.finditer(s):
            add("address", *m.span(), structure=1 if "," in m[0] else -1, gazetteer=1)
    near = _NAME_NEAR.search(s) is not None
    for pattern in (_ZH_NAMES if near else _ZH_NAMES[:2]) if _CJK.search(s) else ():
        for m in pattern.finditer(s):
            add("name", *m.span("v"), structure=1 if len(m["v"]) <= 4 else -1, gazetteer=1)
    if _LATIN.search(s):
        for pattern in _EN_NAMES:
            for m in pattern.finditer(s):
                add("name", *m.span("v"), structure=1)
    return [(k, a, b, tuple(v)) for (k, a, b), v in spans.items()]


_CJK = re.compile("[一-鿿]")
_LATIN = re.compile("[A-Z][a-z]")
_DIGITS = re.compile(r"\d")
# What must stand somewhere in a text before its slower patterns are tried: wide forms, a numbered house, words after a name.
_HAS_WIDE, _NUMBERED, _NAME_NEAR = re.compile("[０-９＋－（）＠．　／]"), re.compile(r"\d号"), re.compile(f"{TITLES}|签字|来信|致电|{_ZH_SPOKE}")
#: What a name may look like wherever it stands; the learned names decide.
_MAYBE_NAME = re.compile(f"(?=(?P<h>{_SURNAME}[一-鿿]{{1,2}}))|\\b(?P<l>{_WORD}(?: {_WORD}){{1,2}})")


def neighbour(c: str) -> str:
    """The class of a character beside a span."""
    return "edge" if not c else "han" if _CJK.match(c) else "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else "colon" if c in ":：" else "mark"


def shape(kind: str, value: str) -> str:
    """The form of a value: its script and words for names and addresses, its punctuation and digits for the others."""
    if kind == "name":
        return f"han{len(value)}" if _CJK.search(value) else f"words{len(value.split())}"
    if kind == "address":
        return ("han" if _CJK.search(value) else "latin") + ("-placed" if re.search("[省市区县,]", value) else "")
    if kind == "email":
        return "sign" if "@" in value or "＠" in value else "word"
    digits = sum(c.isdigit() for c in value)
    marks = "".join(sorted({c for c in value if not c.isalnum()}))
    return f"{'plus' if value[:1] in '+＋' else 'zero' if value[:1] in '0０' else 'plain'}-{min(digits, 19)}-{marks[:4]}"


def described(text: str, kind: str, start: int, stop: int) -> tuple[str, str, str]:
    """FEATURES of a span."""
    return shape(kind, text[start:stop]), neighbour(text[start - 1 : start] if start else ""), neighbour(text[stop : stop + 1])


def _logistic(features: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic classifier of soft targets, by Newton steps with a penalty on large weights."""
    w = np.zeros(features.shape[1])
    weight = weight / weight.sum()
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (weight * (target - q)) - ridge * w
        curve = (features * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ features + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def estimate(patterns: dict[tuple, int], rounds: int = 50) -> dict[tuple, float]:
    """The probability that spans with a pattern (kind, votes, features...) are real.

    Expectation-maximisation over the counts of vote patterns: each labeler of a kind has the probabilities of its votes given
    real and given not; spans start from the majority of votes. What it finds is the soft label of a logistic classifier of each kind
    whose features are the votes, pairs of votes, and the span's form and neighbours; its output is the
    probability. Votes alone give a pattern without features.
    """
    result: dict[tuple, float] = {}
    for kind in sorted({k[0] for k in patterns}):
        items = sorted(((k[1], k[2:], n) for k, n in patterns.items() if k[0] == kind), key=str)
        votes, counts = np.array([v for v, _, _ in items]), np.array([n for _, _, n in items], dtype=float)
        onehot = np.stack([votes == x for x in (-1, 0, 1)], axis=2).astype(float)
        p = np.clip(0.5 + votes.sum(axis=1) / (2.0 * votes.shape[1]), 0.05, 0.95)
        for _ in range(rounds):
            w1, w0 = counts * p, counts * (1 - p)
            # A labeler is taken to be better than chance: pseudo-counts lean that way.
            prior1, prior0 = np.array([1.0, 2.0, 5.0]), np.array([5.0, 2.0, 1.0])
            given1 = (np.einsum("i,ijk->jk", w1, onehot) + prior1) / (w1.sum() + 8)
            given0 = (np.einsum("i,ijk->jk", w0, onehot) + prior0) / (w0.sum() + 8)
            base = (w1.sum() + 2) / (counts.sum() + 4)
            odds = np.log(base / (1 - base)) + np.einsum("ijk,jk->i", onehot, np.log(given1) - np.log(given0))
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        pairs = [votes[:, a] * votes[:, b] for a in range(votes.shape[1]) for b in range(a)]
        known = sorted({(i, x) for _, f, _ in items for i, x in enumerate(f)})
        traits = np.array([[float(f[i] == x) for i, x in known] for _, f, _ in items]).reshape(len(items), len(known))
        features = np.concatenate([np.ones((len(items), 1)), votes, np.abs(votes), np.array(pairs, dtype=float).T.reshape(len(items), len(pairs)), traits], axis=1)
        q = 1 / (1 + np.exp(-np.clip(features @ _logistic(features, p, counts), -30, 30)))
        for (v, f, _), b in zip(items, q):
            result[(kind, v, *f)] = float(b)
    return result


def _name_hash(value: str) -> int:
    return zlib.crc32(value.encode()) & ((1 << NAME_BITS) - 1)


def pii_spans(df: DataFrame, doc_id: str, text: str, threshold: float = 0.5) -> DataFrame:
    """The personal values in a text column: doc_id, kind, start, stop, value, probability.

    Every labeler votes on every proposed span over all whole texts, or abstains. Spans are proposed by patterns, and by the gazetteer: names that
    stand in a clear context at least twice are learned, and a second scan proposes them wherever else they stand, by a filter of
    bounded size and a join by name, however many there are. The counts of patterns of votes and features, of which there
    is a bounded number whatever the data, go to the driver, where expectation-maximisation estimates the labelers' reliabilities and
    trains the final classifier of spans. Of overlapping spans the more probable, then the longer one stays.

    start and stop are code point offsets, and value is exactly text[start:stop]. Null and empty texts, and null ids, have no spans.
    The spans of rows with the same id and text come out once; repeated texts under two ids come out under both. Empty tables give none.
    """
    spark = df.sparkSession
    id_type = df.schema[doc_id].dataType.simpleString()
    votes, traits = [f"{x} int" for x in LABELERS], [f"{x} string" for x in FEATURES]
    schema = f"i {id_type}, kind string, start int, stop int, value string, {', '.join(votes + traits)}"
    columns = ["i", "kind", "start", "stop", "value", *LABELERS, *FEATURES]

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, a, b, t[a:b], *v, *described(t, k, a, b)) for i, t in zip(pdf["i"], pdf["t"]) if t for k, a, b, v in label_spans(t)]
            yield pd.DataFrame(rows, columns=columns)

    texts = df.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    raw = cut(spread(texts, "i").mapInPandas(label, schema))
    learned = cut(raw.where("kind = 'name' and context = 1 and structure = 1").groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(F.col("value").alias("known")))
    # At most 2^NAME_BITS numbers, whatever the names.
    bits = np.zeros(1 << NAME_BITS, dtype=bool)
    slots = learned.select((F.crc32(F.encode("known", "UTF-8")) % (1 << NAME_BITS)).cast("int").alias("h")).distinct().toArrow()
    bits[slots["h"].to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def bare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside = np.unpackbits(shared.value).view(bool)
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["i"], pdf["t"]):
                for m in _MAYBE_NAME.finditer(t) if t else ():
                    a, whole = m.start(), m["h"] or m["l"]
                    for value in {whole, whole[:-1]} if m["h"] else {whole}:
                        if len(value) > 1 and inside[_name_hash(value)]:
                            rows.append((i, "name", a, a + len(value), value, 0, 0, 1, 1 if _FOR["name"].search(t[max(0, a - 18) : a] + "\n" + t[a + len(value) : a + len(value) + 8]) else 0, 0, *described(t, "name", a, a + len(value))))
            yield pd.DataFrame(rows, columns=columns)

    found = texts.mapInPandas(bare, schema) if bits.any() else raw.limit(0)
    proposed = found.join(learned, F.col("value") == F.col("known"), "left_semi").join(raw.select("i", "kind", "start", "stop").distinct(), ["i", "kind", "start", "stop"], "left_anti")
    seen = raw.join(learned, (F.col("kind") == "name") & (F.col("value") == F.col("known")), "left").withColumn("gazetteer", F.when(F.col("known").isNotNull(), 1).otherwise(F.col("gazetteer"))).drop("known")
    seen = cut(seen.unionByName(proposed.select(*columns)))
    pattern = ["kind", *LABELERS, *FEATURES]
    counted = seen.groupBy(*pattern).agg(F.count(F.lit(1)).alias("n")).collect()
    model = estimate({(r["kind"], tuple(r[x] for x in LABELERS), *(r[x] for x in FEATURES)): r["n"] for r in counted})
    if not model:
        return raw.select(F.col("i").alias(doc_id), "kind", "start", "stop", "value", F.lit(0.0).alias("probability"))
    table = spark.createDataFrame([(k[0], *k[1], *k[2:], p) for k, p in sorted(model.items(), key=str)], f"kind string, {', '.join(votes + traits)}, probability double")
    scored = seen.join(F.broadcast(table), pattern).where(F.col("probability") >= threshold)

    # Few spans stand in one document, so the overlaps are settled in an array of each document.
    spans = scored.groupBy("i").agg(F.array_sort(F.collect_set(F.struct((-F.col("probability")).alias("p"), (F.col("start") - F.col("stop")).alias("len"), "start", "stop", "kind", "value"))).alias("s"))
    kept = F.aggregate("s", F.expr("cast(array() as array<struct<p:double,len:int,start:int,stop:int,kind:string,value:string>>)"), lambda acc, x: F.when(F.exists(acc, lambda y: (y["start"] < x["stop"]) & (x["start"] < y["stop"])), acc).otherwise(F.array_append(acc, x)))
    return spans.select(F.col("i").alias(doc_id), F.explode(kept).alias("x")).select(doc_id, "x.kind", "x.start", "x.stop", "x.value", (-F.col("x.p")).alias("probability"))


def redacted(df: DataFrame, doc_id: str, text: str, spans: DataFrame) -> DataFrame:
    """df with typed placeholders such as [EMAIL] in place of the spans; everything else stays as it is.

    doc_id must be unique. Nulls stay null; rows without spans stay unchanged.
    """
    key, found = free_name("key", df), free_name("spans", df)
    per = spans.groupBy(F.col(doc_id).alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias(found))
    joined = df.join(per, F.col(doc_id) == F.col(key), "left").drop(key)

    def replace(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            out = []
            for t, spans_ in zip(texts, lists):
                for x in reversed(list(spans_)) if t and spans_ is not None else ():
                    t = f"{t[: x['start']]}[{x['kind'].upper()}]{t[x['stop'] :]}"
                out.append(t)
            yield pd.Series(out)

    clean = F.pandas_udf(replace, "string")
    return joined.withColumn(text, F.when(F.col(found).isNull(), F.col(text)).otherwise(clean(F.col(text), F.col(found)))).drop(found)
