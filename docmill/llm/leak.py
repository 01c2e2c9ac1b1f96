"""Evaluation texts that leak into training text (problem 8)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.rolling import code_points, folded, sub_batches, text_of, windows
from docmill.session import cut, spread

#: Bits of the filter that drops windows of documents before the join, whatever the number of items (2^26 bits, 8 MB).
FILTER_BITS = 26
#: Rows of the index of windows (16 bytes each) that are broadcast; a larger one is joined by a shuffle, salted by document.
BROADCAST_ROWS, SALTS = 2_000_000, 16
#: Template windows: hashed at every place of an item, at every STEP-th place of a document.
WIDTH, STEP = 32, 8
NUMBER, UNIT, NAME = "\ue001", "\ue002", "\ue003"
# Words that count or measure what the number before them says; the longest has 8 letters.
UNITS = (
    "个百分点 百分点 个月 个 例 元 万元 亿元 美元 小时 分钟 秒 天 日 周 月 年 台 份 件 项 批次 批 吨 公斤 千克 克 毫克 毫米 厘米 微米 公里 千米 米 升 毫升 度 名 人 次 家 套 辆 条 处 倍 岁 页 期 场 轮 号 级 "
    "units lots hours minutes seconds days weeks months years stations grade grades tonnes tons kg km cm mm metres meters litres liters percent dollars euros people rounds times pages"
).split()
# How test items name organisations and persons, and numerals.
_ORGANISATION = r"某[一-鿿]{1,8}?(?:公司|集团|企业|机构|工厂|厂|学校|医院|银行|商店|商)"
_PERSON = "[王李张刘陈杨赵黄周吴]某某?|某[甲乙丙丁]|小[明红华刚丽强芳军]"
_NUMERALS = "〇零一二三四五六七八九十百千万亿两"
_UNIT = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))
_SLOT = re.compile(rf"({_ORGANISATION}|{_PERSON})|(\d+[百千万亿]*|[{_NUMERALS}]{{2,}})({_UNIT})?")
_ENDS = re.compile("公司|集团|企业|机构|厂|学校|医院|银行|商")
#: Letters that a unit, or the name of an organisation, can reach over an edge.
_UNIT_REACH, _NAME_REACH = 8, 11


def template(stream: str) -> tuple[str, np.ndarray, list[tuple[int, str]]]:
    """(template, starts, slots) of letters and digits: names, numbers and units after a number become typed placeholders.

    starts has the place in the stream of every template character, and the stream's length; slots are (place in the template, value).
    """
    out, slots, at, size = [], [], 0, 0
    begins = np.ones(len(stream) + 1, dtype=bool)
    for m in _SLOT.finditer(stream):
        a, z = m.span()
        out.append(stream[at:a])
        size += a - at
        at = z
        value, number, unit = m.groups()
        if value:
            slots.append((size, value))
            out.append(NAME)
        else:
            slots.append((size, number))
            out.append(NUMBER)
        begins[a + 1 : z] = False
        size += 1
        if unit:
            slots.append((size, unit))
            out.append(UNIT)
            begins[z - len(unit)] = True
            size += 1
    out.append(stream[at:])
    return "".join(out), np.flatnonzero(begins), slots


def _short_of_template(stream: str, starts: np.ndarray, run: int) -> np.ndarray:
    """Places where a passage of ``run`` letters may begin that no template window is sure to find.

    A window is sure to lie in it if WIDTH + STEP - 1 template characters do, apart from those at its edges that the text
    around it may change: a unit whose number stands before, a name that begins before or ends after it.
    """
    n = len(stream) - run + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    size = len(stream)
    name_ends, name_begins = np.zeros(size + 1, dtype=np.int64), np.zeros(size + 1, dtype=np.int64)
    for m in _ENDS.finditer(stream):
        name_ends[m.end()] = 1
    for m in re.finditer("[某小王李张刘陈杨赵黄周吴明红华刚丽强芳军甲乙丙丁]", stream):
        name_begins[m.start()] = 1
    ended, begun = np.cumsum(name_ends), np.cumsum(name_begins)
    a = np.arange(n)
    within = lambda sums, lo, hi: sums[np.minimum(hi, size)] - np.where(lo > 0, sums[np.maximum(lo - 1, 0)], 0) > 0  # noqa: E731  lo..hi inclusive
    loose_left = within(ended, a + 1, a + _NAME_REACH) | within(begun, a, a + 1)
    loose_right = within(begun, a + run - _NAME_REACH, a + run - 1)
    first = np.searchsorted(starts, a + _UNIT_REACH, "left")
    last = np.searchsorted(starts, a + run - _NAME_REACH * loose_right, "right") - 1
    return loose_left | (last - first < WIDTH + STEP - 1)


def _verbatim_shape(run: int) -> tuple[int, int]:
    """(width, step): every passage of ``run`` letters holds one of the windows of that width at each step-th place."""
    step = max(1, run // 3)
    return run - step + 1, step


def item_hashes(text: str, run: int) -> list[np.ndarray]:
    """Hashes of all template windows, and of all windows of letters."""
    stream = folded(text)
    return [windows(code_points(template(text_of(stream))[0]), WIDTH), ~windows(stream, _verbatim_shape(run)[0])]


def document_hashes(text: str, run: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of the windows of a document that are looked up: of templates at every STEP-th place, and of letters
    where the template may be too short."""
    stream = folded(text)
    letters = text_of(stream)
    form, starts, _ = template(letters)
    found = windows(code_points(form), WIDTH)
    at = np.arange(0, len(found), STEP)
    width, step = _verbatim_shape(run)
    short = _short_of_template(letters, starts, run)
    own = np.arange(0, max(0, len(stream) - width + 1), step)
    if len(short) and short.any():
        sums = np.concatenate([[0], np.cumsum(short)])
        lo, hi = np.clip(own + width - run, 0, len(short)), np.clip(own + 1, 0, len(short))
        own = own[sums[hi] > sums[np.minimum(lo, hi)]]
        return [(at, found[at]), (own, ~windows(stream, width)[own])]
    return [(at, found[at])]


@dataclass(frozen=True)
class Shape:
    """What comparing needs of a text: template characters, slots by place, hashes of all runs, sorted too."""

    form: np.ndarray
    slots: dict[int, str]
    runs: np.ndarray
    sorted_runs: np.ndarray


@lru_cache(maxsize=4096)
def shape_of(text: str, run: int) -> Shape:
    stream = folded(text)
    form, _, slots = template(text_of(stream))
    runs = windows(stream, run)
    return Shape(code_points(form), dict(slots), runs, np.unique(runs))


def _longest(flags: np.ndarray) -> tuple[int, int]:
    """(length, start) of the longest stretch of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    if not len(edges):
        return 0, 0
    sizes = edges[1::2] - edges[::2]
    return int(sizes.max()), int(edges[::2][sizes.argmax()])


def compare(doc: str, item: str, shifts: list[int], run: int) -> tuple[int, int, int, int, bool]:
    """(verbatim, aligned, slots, equal, consistent) of a document and an item.

    verbatim: the longest stretch of consecutive letters and digits of the document whose every ``run`` stand in the item, 0 if
    it is under ``run``. aligned: the length of the longest stretch with the same template, on one of the diagonals ``shifts``;
    slots, equal: its slots, and those with the same value; consistent: whether one value of the item always stands for one value
    of the document and the other way round, as where a question was asked with other figures.
    """
    a, b = shape_of(doc, run), shape_of(item, run)
    verbatim = 0
    if len(a.runs) and len(b.sorted_runs):
        at = np.minimum(np.searchsorted(b.sorted_runs, a.runs), len(b.sorted_runs) - 1)
        most, _ = _longest(b.sorted_runs[at] == a.runs)
        verbatim = most + run - 1 if most else 0
    best = (0, 0, 0)
    for shift in shifts:
        lo, hi = max(0, -shift), min(len(a.form), len(b.form) - shift)
        if hi > lo:
            length, start = _longest(a.form[lo:hi] == b.form[lo + shift : hi + shift])
            best = max(best, (length, -(start + lo), shift))
    aligned, start, shift = best[0], -best[1], best[2]
    pairs = [(b.slots.get(p + shift), v) for p, v in a.slots.items() if start <= p < start + aligned]
    distinct = set(pairs)
    consistent = len({x for x, _ in distinct}) == len(distinct) == len({y for _, y in distinct})
    return verbatim, aligned, len(pairs), sum(x == y for x, y in pairs), consistent


def _filter_words(keys: DataFrame) -> np.ndarray:
    """A bit for every hash, in at most 2^(FILTER_BITS - 6) words, which is all that the driver ever sees of the items."""
    word = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit((1 << (FILTER_BITS - 6)) - 1)).cast("int")
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    rows = keys.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("x")).toArrow()
    words = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    words[rows["w"].to_numpy()] = rows["x"].to_numpy().view(np.uint64)
    return words


def _known_windows(shared, run: int):
    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared.value
        inside = np.uint64(len(words) - 1)
        for pdf in (part for batch in batches for part in sub_batches(batch, "dt")):
            rows = []
            for d, t in zip(pdf["d"], pdf["dt"]):
                hashes, places = [], []
                for at, h in document_hashes(t, run) if t else ():
                    hit = (words[((h >> np.uint64(6)) & inside).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1
                    hashes += h[hit].view(np.int64).tolist()
                    places += at[hit].tolist()
                if hashes:
                    rows.append((d, t, hashes, places))
            if rows:
                yield pd.DataFrame(rows, columns=["d", "dt", "hs", "ps"])

    return look_up


def leaked_items(documents: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, min_run: int = 50) -> DataFrame:
    """Pairs of documents and items with a common stretch of template: doc_id, item_id, verbatim_run,
    template_run, slots, slots_equal, slots_consistent and reworded.

    Letters and digits are taken without case, width, spaces and punctuation; numbers, units after them and names of
    organisations and persons become typed placeholders. Items are hashed in windows of WIDTH template characters at every
    place, documents at every STEP-th, and joined by hash. Where placeholders leave a passage of ``min_run`` letters so short that
    no window is sure to lie in it (tables of figures, rows of names), windows of its letters themselves are
    joined too, so that no passage of ``min_run`` is missed. A filter of bounded size drops windows that no item has before the join.

    Every pair so found is compared exactly: ``verbatim_run`` is the longest common stretch if it has at least ``min_run`` letters
    and digits, else 0; ``reworded`` is true if there is none, but the template agrees over ``min_run``, a slot differs, and
    the slots are consistent (a question asked with other figures).

    Null and empty texts, and null ids, match nothing. Repeated documents and items each come out under their own id. Empty
    tables give no rows.
    """
    spark = documents.sparkSession
    d_type, i_type = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    docs = spread(documents.select(F.col(doc_id).alias("d"), F.col(doc_text).alias("dt")).where("d is not null and dt is not null"), "d")
    them = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("it")).where("i is not null and it is not null")

    def item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for batch in batches for part in sub_batches(batch, "it")):
            for i, t in zip(pdf["i"], pdf["it"]):
                for h in item_hashes(t, min_run):
                    keys, first = np.unique(h, return_index=True)
                    yield pd.DataFrame({"i": i, "h": keys.view(np.int64), "p": first.astype(np.int32)})

    index = cut(them.mapInPandas(item_windows, f"i {i_type}, h long, p int").distinct())
    shared = spark.sparkContext.broadcast(_filter_words(index))
    found = cut(docs.mapInPandas(_known_windows(shared, min_run), f"d {d_type}, dt string, hs array<long>, ps array<int>"))
    hits = found.select("d", F.explode(F.arrays_zip("hs", "ps")).alias("x")).select("d", F.col("x.hs").alias("h"), F.col("x.ps").alias("q"))
    if index.count() <= BROADCAST_ROWS:
        met = hits.join(F.broadcast(index), "h")
    else:
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = hits.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"])
    pairs = cut(met.groupBy("d", "i").agg(F.collect_set(F.col("p") - F.col("q")).alias("shifts")))
    texts = found.select("d", "dt").distinct()

    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b, shifts in batches:
            yield pd.DataFrame([compare(x, y, list(s), min_run) for x, y, s in zip(a, b, shifts)], columns=["verbatim_run", "template_run", "slots", "slots_equal", "slots_consistent"])

    # Not deterministic to the optimiser, which would otherwise score before the pairs are spread.
    scorer = F.pandas_udf(score, "verbatim_run int, template_run int, slots int, slots_equal int, slots_consistent boolean").asNondeterministic()
    # A document's pairs stand together, so that its text is prepared once; tasks get a bounded number of pairs.
    tasks = max(2 * spark.sparkContext.defaultParallelism, pairs.count() // 5000)
    together = pairs.join(texts, "d").join(them, "i").repartition(tasks, "d", "dt").sortWithinPartitions("d")
    out = together.withColumn("s", scorer("dt", "it", "shifts")).select(F.col("d").alias(doc_id), F.col("i").alias(item_id), "s.*")
    return out.withColumn("reworded", (F.col("verbatim_run") == 0) & (F.col("template_run") >= min_run) & (F.col("slots_equal") < F.col("slots")) & F.col("slots_consistent"))
