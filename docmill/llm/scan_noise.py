"""Repairing text extracted from scanned pages by a noisy channel (problem 4)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.ngram import ORDER, KneserNey, arrays, count_grams, fit, look_up, packed
from docmill.llm.rolling import code_points, sub_batches
from docmill.session import cut, spread

# Character read -> characters that it may stand for; others are found in the corpus itself (see learned_confusions).
MISREAD = {
    "可": "司", "严": "产", "己": "已", "没": "设", "尸": "户", "菅": "管", "淮": "准", "埋": "理", "最": "量", "巿": "市", "侧": "测", "吿": "告", "末": "未", "牧": "收", "人": "入", "必": "心", "此": "比", "竟": "境", "诋": "证", "休": "体", "厍": "序库", "节": "书", "顷": "项", "亊": "事", "沦": "论", "贡": "责",
    "入": "人", "未": "末", "土": "士", "士": "土", "干": "千", "千": "干", "日": "曰", "曰": "日", "大": "太", "太": "大", "天": "夭", "夭": "天", "戍": "戌", "冶": "治", "治": "冶", "住": "佳往", "佳": "住", "晴": "睛", "睛": "晴", "拔": "拨", "拨": "拔", "析": "折", "折": "析", "侯": "候", "候": "侯", "亨": "享", "享": "亨", "徒": "徙", "楝": "栋", "汆": "氽", "兔": "免", "免": "兔", "刺": "剌", "帅": "师", "鸟": "乌", "乌": "鸟", "王": "玉", "玉": "王", "丸": "九", "问": "间", "间": "问", "闩": "门", "囗": "口", "旳": "的", "员": "贝", "贝": "见", "园": "圆", "氷": "水", "永": "水", "夲": "本", "木": "本", "禾": "木", "杋": "机", "朾": "打", "枝": "技", "技": "枝", "抜": "拔", "诮": "消", "沽": "活", "话": "活", "洁": "活", "侍": "待", "持": "特", "恃": "持", "准": "淮", "卖": "买", "买": "卖", "弟": "第", "笫": "第", "亍": "于", "丁": "于", "与": "写",
}
# Characters that are read for one another at the ends of names and titles, which are compared in one form.
SAME_SHAPE = str.maketrans({"可": "司", "严": "产", "己": "已", "没": "设", "尸": "户", "菅": "管", "淮": "准", "埋": "理", "最": "量", "巿": "市", "侧": "测", "吿": "告", "末": "未", "牧": "收", "必": "心", "此": "比", "竟": "境", "诋": "证", "休": "体", "厍": "库", "节": "书", "顷": "项", "亊": "事", "沦": "论", "贡": "责"})
#: Expected misreadings and readings of a pair before any were counted, and the least probability a pair is given.
PRIOR_WRONG, PRIOR_RIGHT, LEAST_CHANNEL = 2.0, 200.0, 1e-4
#: The odds that a Latin word or number that can be misread has been.
CHANNEL = 0.1
#: A pair that no table lists is taken up if so much of what is read as the first character stands where the second one is usual,
#: at least ODDS times as often, in so many contexts, and the second is that much commoner.
EXPLAINED, CONTEXTS, ODDS = 0.6, 3, 9
KINDS = ("hyphen_break", "ocr_char", "running_header", "page_number")

_SPACE = " \t　\xa0"
_PAGE = re.compile(r"^[{0}]*(?:[-—–][{0}]*\d{{1,4}}[{0}]*[-—–]|\d{{1,4}}|第[{0}]*\d{{1,4}}[{0}]*页(?:[{0}]*[,，/]?[{0}]*共[{0}]*\d{{1,4}}[{0}]*页)?|(?:Page|PAGE|page|P\.?|p\.)[{0}]*\d{{1,4}}(?:[{0}]*(?:of|/)[{0}]*\d{{1,4}})?|\d{{1,4}}[{0}]*/[{0}]*\d{{1,4}}|[〔\[(（【][{0}]*\d{{1,4}}[{0}]*[〕\])）】])[{0}]*$".format(_SPACE))
_DIVIDED = re.compile(rf"([A-Za-z]{{2,}})[-‐\xad¬][{_SPACE}]*\n[{_SPACE}]*([a-z]++)(?!-)")
_REPORT = r"(?:(?:19|20)\d{2})年?(?:度)?(?:半?年度报告|年度报告|年报)(?:全文|摘要|正文)?"
# How an English report names itself, with the year on either side.
_ENGLISH_REPORT = re.compile(r"^(?:[A-Z][\w.&-]*(?: [A-Z&][\w.&-]*){0,7} )?(?:(?:19|20)\d{2} )?(?:(?:Semi-?|Half-?|Interim )?Annual|Interim|Half-Year|Quarterly|ANNUAL|INTERIM) (?:Report|REPORT)(?:[ ,/-]+(?:19|20)\d{2})?$")
_TITLE_PAGE = re.compile(rf"(?:[.…·•_]{{2,}}[{_SPACE}]*\d{{1,4}}|[{_SPACE}]+[-—–]?[{_SPACE}]*\d{{1,4}}[{_SPACE}]*[-—–]?|[-—–][{_SPACE}]*\d{{1,4}}[{_SPACE}]*[-—–]|[{_SPACE}]*第[{_SPACE}]*\d{{1,4}}[{_SPACE}]*页(?:[{_SPACE}]*共[{_SPACE}]*\d{{1,4}}[{_SPACE}]*页)?|[{_SPACE}]*(?:Page|P\.)[{_SPACE}]*\d{{1,4}}(?:[{_SPACE}]*(?:of|/)[{_SPACE}]*\d{{1,4}})?|[{_SPACE}]*[〔\[(（【]\d{{1,4}}[〕\])）】]|(?<=[一-鿿])\d{{1,4}}(?:[{_SPACE}]*/[{_SPACE}]*\d{{1,4}})?)[{_SPACE}]*$")
_MARKER = re.compile(r"^第[一二三四五六七八九十百\d]+[章节]")
_TABLE = re.compile(r"\S[ \t]{2,}[-\d,.]+[ \t]{2,}|^单位：|□|√")
_STOPS, _CLOSERS = tuple("。！？；!?;：:."), "”’」』）)\"'"
_HEADING = re.compile(r"^(?:[（(][一二三四五六七八九十\d]+[)）]|[一二三四五六七八九十\d]+[、.．]|[-•·] |第.{1,4}[章节])")
_VALUE = re.compile(rf"^[{_SPACE}]*[-+]?\d[\d,./]*[%％]?[{_SPACE}]*$")
_LATIN_WORD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{2,}(?![A-Za-z0-9])")


def _squeezed(s: str) -> str:
    return re.sub(r"\s+", "", s).translate(SAME_SHAPE)


@lru_cache(maxsize=4096)
def company_names(company: str | None, source_file: str | None) -> list[str]:
    """Full names of the company, as the row and the file name spell it, without spaces and misread characters."""
    found = []
    if source_file:
        stem = source_file.rsplit(".", 1)[0]
        found += [p for p in stem.split("_") if re.search("[一-鿿]", p) and "报告" not in p]
    if company:
        found.append(re.sub(r"[()（）]", "", company))
    return list(dict.fromkeys(_squeezed(re.sub(r"^\*?ST", "", x)) for x in found if x.strip()))


def _is_name(s: str, names: list[str]) -> bool:
    """Whether s is a company name, full or shortened at its end."""
    s = re.sub(r"^\*?ST|[()（）]", "", s)
    return bool(s) and any(n == s or len(s) >= 4 and n.startswith(s) for n in names) or bool(re.fullmatch(r"[一-鿿]{2,16}(?:股份|集团)有限公司", s))


def is_running_header(line: str, before: str, names: list[str], chapter: str) -> bool:
    """A line that is the company's name, the report's title, both, or the chapter's title with or without the name."""
    if len(line) > 200:  # no such line has more than 60 characters besides spaces
        return False
    plain = " ".join(line.split())
    if "EPORT" in plain.upper() and _ENGLISH_REPORT.match(plain) and re.search(r"\d{4}", plain):
        return True
    s = _squeezed(line)
    if not s or len(s) > 60:
        return False
    if m := re.search(rf"{_REPORT}$", s):
        head = s[: m.start()].rstrip("·|-—_:：")
        if not head:
            return not re.search(r"(?:详见|参见|见)(?:本?公司)?$", _squeezed(before))
        return _is_name(head, names)
    if _is_name(s, names):
        return True
    for n in sorted(names, key=len, reverse=True):
        if s.startswith(n) and len(s) > len(n):
            s = s[len(n) :].lstrip("·|-—_")
            if re.fullmatch("[一-鿿]{2,12}", s) and re.search(r"[\s　·|]", line.strip()):
                return True  # the name and a chapter's title, of this chapter or of another one
            break
    return len(chapter) >= 4 and _MARKER.sub("", s) == chapter


def clean_title(title: str | None, names: list[str]) -> tuple[str, set[str]]:
    """A chapter title without page number, company name and report title, and the kinds of noise it had."""
    if not title:
        return title or "", set()
    s, kinds = _clean_title(title, tuple(names))
    return s, set(kinds)


@lru_cache(maxsize=65536)
def _clean_title(title: str, names: tuple[str, ...]) -> tuple[str, frozenset[str]]:
    kinds, s = set(), title.strip()
    if m := _TITLE_PAGE.search(s):
        if re.search("[一-鿿A-Za-z]", s[: m.start()]):
            kinds.add("page_number")
            s = s[: m.start()].rstrip(_SPACE + ".…·")
    for _ in range(2):
        flat = s.translate(SAME_SHAPE)
        for n in sorted(names, key=len, reverse=True):
            loose = re.compile(r"\s*".join(map(re.escape, n)))
            if (m := loose.search(flat)) and len(s) - (m.end() - m.start()) >= 2:
                kinds.add("running_header")
                s = (s[: m.start()] + " " + s[m.end() :]).strip()
                break
        flat = s.translate(SAME_SHAPE)
        if (m := re.search(r"(?:(?:19|20)\d{2})?\s*年?\s*(?:半?年度报告|年报)(?:全文|摘要|正文)?", flat)) and len(s) - (m.end() - m.start()) >= 2:
            kinds.add("running_header")
            s = (s[: m.start()] + " " + s[m.end() :]).strip()
    if m := re.match(r"^[一-鿿()（）]{2,16}(?:股份|集团)有限公司(?=.*第.{1,4}[章节])", _squeezed(s)):
        kinds.add("running_header")
    return s.strip(_SPACE + "·|-—_"), frozenset(kinds)


def is_page_number(lines: list[str], at: int) -> bool:
    """A page number on a line of its own. A bare figure or fraction isn't one in a column of three and more bare values, nor is a year."""
    s = lines[at].strip(_SPACE)
    if len(s) > 40 or not _PAGE.match(s):
        return False
    if not re.fullmatch(r"\d{1,4}|\d{1,4}\s*/\s*\d{1,4}", s):
        return True
    if re.fullmatch(r"(?:19|20)\d\d", s):
        return False
    beside = 0
    for side in (reversed(lines[:at]), lines[at + 1 :]):
        for x in side:
            if x.strip(_SPACE) and not _VALUE.match(x):
                break
            beside += bool(x.strip(_SPACE))
            if beside > 1:
                return False
    return True


def page_structure(text: str, names: list[str], chapter: str) -> tuple[str, set[str]]:
    """The text without page numbers and running headers, words rejoined, lines of a paragraph continuous."""
    kinds, kept = set(), []
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    for at, line in enumerate(lines):
        if not line.strip(_SPACE):
            kept.append("")
        elif is_page_number(lines, at):
            kinds.add("page_number")
        elif is_running_header(line, kept[-1] if kept else "", names, chapter):
            kinds.add("running_header")
        else:
            kept.append(line.rstrip(_SPACE))
    body, n = _DIVIDED.subn(r"\1\2", "\n".join(kept))
    if n:
        kinds.add("hyphen_break")
    out: list[str] = []
    goes_on = False  # whether the last line may continue: neither ended nor a heading nor a line of a table
    for line in body.split("\n"):
        s = line.strip(_SPACE)
        own = bool(s) and not _HEADING.search(s) and not _TABLE.search(s)
        if own and goes_on:
            last = out[-1]
            gap = " " if last[-1].isascii() and s[0].isascii() and (last[-1].isalnum() or last[-1] in ",.;)") and s[0].isalnum() else ""
            out[-1] = last + gap + s
        else:
            out.append(s)
        goes_on = own and s.rstrip(_CLOSERS)[-1:] not in _STOPS
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n"), kinds


def stream(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(characters, places) of a text for the model: without spaces, a run of digits as one 0; places are offsets in the text."""
    codes = code_points(text)
    digit = (codes >= 48) & (codes <= 57)
    keep = ~((codes <= 32) | (codes == 0x3000) | (codes == 0xA0))
    keep[1:] &= ~(digit[1:] & digit[:-1])
    return np.where(digit, 48, codes)[keep].astype(np.uint32), np.flatnonzero(keep)


def learned_confusions(grams: DataFrame) -> tuple[dict[str, dict[str, float]], DataFrame]:
    """(read -> meant -> probability that a character meant was read so, n-grams without those that misreading explains), by
    expectation-maximisation over the corpus.

    grams: (lang, gram, n). A context is an n-gram with one character left open. Where one character is at least ODDS times
    as frequent in a context as another one, the other may be a misreading of it. Candidates are the pairs of the table,
    and pairs for which most of what is read as the first character stands in such contexts of one second character. For each
    kept pair the expected number of misreadings, weighed by the chance that the character was meant as read, gives its
    probability again, until it stays. N-grams in which a kept pair stands in such a context would make their own errors likely, so the
    model is fitted without them. The counts are made by Spark from all n-grams; a row a pair, of which the characters
    of a script bound the number, comes to the driver.
    """
    at = F.col("pos") * 16
    opened = grams.select("lang", "gram", "n", F.explode(F.sequence(F.lit(0), F.lit(ORDER - 1))).alias("pos"))
    opened = opened.select("lang", "gram", "n", "pos", F.call_function("shiftrightunsigned", "gram", at).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("x"), F.col("gram").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(0xFFFF).cast("long"), at))).alias("ctx")).where(F.col("x").between(0x3400, 0x9FFF))
    totals = opened.groupBy("x").agg(F.sum("n").alias("total"))
    top = opened.groupBy("lang", "pos", "ctx").agg(F.max(F.struct("n", "x")).alias("top"), F.min("n").alias("least"))
    top = top.where(F.col("least") * ODDS <= F.col("top.n")).select("lang", "pos", "ctx", F.col("top.x").alias("y"), F.col("top.n").alias("ny"))
    pairs = cut(opened.join(top, ["lang", "pos", "ctx"]).where((F.col("x") != F.col("y")) & (F.col("n") * ODDS <= F.col("ny"))).select("lang", "gram", "x", "y", "n"))
    found = pairs.groupBy("x", "y").agg(F.sum("n").alias("wrong"), F.count(F.lit(1)).alias("contexts"))
    found = found.join(totals.withColumnsRenamed({"total": "nx"}), "x").join(totals.withColumnsRenamed({"x": "y", "total": "n_y"}), "y")
    listed = {(ord(x), ord(y)) for x, ys in MISREAD.items() for y in ys}
    new = (F.col("wrong") >= EXPLAINED * F.col("nx")) & (F.col("contexts") >= CONTEXTS) & (F.col("nx") * ODDS <= F.col("n_y"))
    in_table = (F.col("x").cast("long") * 0x10000 + F.col("y")).isin([x * 0x10000 + y for x, y in sorted(listed)]) if listed else F.lit(False)
    evidence = {(r["x"], r["y"]): r for r in found.where(new | in_table).collect()}
    everything = totals.agg(F.coalesce(F.sum("total"), F.lit(1))).head()[0]
    channel: dict[str, dict[str, float]] = {}
    for x, y in sorted(listed | set(evidence)):
        r = evidence.get((x, y))
        wrong, nx, ny = (r["wrong"], r["nx"], r["n_y"]) if r else (0, 0, 1)
        c, share = PRIOR_WRONG / (PRIOR_WRONG + PRIOR_RIGHT), 0.0
        for _ in range(20):
            # In these contexts a character is either meant as read, as often as anywhere else, or a misreading of the usual one.
            share = c / (c + max(nx - wrong, 0) / everything)
            c = (wrong * share + PRIOR_WRONG) / (ny + PRIOR_WRONG + PRIOR_RIGHT)
        channel.setdefault(chr(x), {})[chr(y)] = max(c, LEAST_CHANNEL)
    if evidence:
        explained = pairs.join(F.broadcast(grams.sparkSession.createDataFrame(sorted(evidence), "x int, y int")), ["x", "y"]).select("lang", "gram").distinct()
        grams = grams.join(explained, ["lang", "gram"], "left_anti")
    return channel, grams


class Scorer:
    """Log probabilities of n-grams, from sorted arrays or from a dictionary of those asked for."""

    def __init__(self, model: KneserNey | None = None, known: dict[int, float] | None = None) -> None:
        self.model, self.known, self.asked = model, known, set()
        self.asking = model is None and known is None

    def log(self, grams: np.ndarray) -> np.ndarray:
        if self.model is not None:
            return np.log(self.model.probability(grams))
        keys = grams.view(np.int64).tolist()
        if self.asking:
            self.asked.update(keys)
            return np.zeros(len(keys))
        return np.log(np.array([self.known[k] for k in keys], dtype=float))


def viterbi(scorer: Scorer, codes: np.ndarray, options: dict[int, list[tuple[int, float]]], start: int, stop: int) -> list[int]:
    """The likeliest characters at start..stop-1 given candidates, each with the log odds of its misreading (the first was read)."""
    history = [0] * max(0, ORDER - 1 - start) + codes[max(0, start - ORDER + 1) : start].tolist()
    states: dict[tuple[int, ...], tuple[float, list[int]]] = {tuple(history[-(ORDER - 1) :]): (0.0, [])}
    for i in range(start, stop):
        choices = options.get(i, [(int(codes[i]), 0.0)])
        steps = list(product(states.items(), choices))
        grams = np.array([(h[0] << 48) | (h[1] << 32) | (h[2] << 16) | c for (h, _), (c, _) in steps], dtype=np.uint64)
        following: dict[tuple[int, ...], tuple[float, list[int]]] = {}
        for ((h, (score, path)), (c, odds)), lp in zip(steps, scorer.log(grams)):
            total, key = score + float(lp) + odds, (*h[1:], c)
            if key not in following or total > following[key][0]:
                following[key] = (total, [*path, c])
        states = following
    return max(states.values(), key=lambda x: x[0])[1]


def _log_odds(channel: dict[str, dict[str, float]]) -> dict[int, list[tuple[int, float]]]:
    """read -> (meant, log odds of the misreading), by code point."""
    return {ord(x): [(ord(m), float(np.log(c / (1 - c)))) for m, c in ys.items()] for x, ys in channel.items()}


def correct_characters(scorer: Scorer, texts: list[str], channel: dict[str, dict[str, float]]) -> list[dict[int, str]]:
    """For each text the offsets to change and the characters to put there.

    Candidates of a line that share no n-gram are independent, so each cluster of them is decoded alone: a single place by
    comparing its candidates, several by Viterbi. A cluster is left out only if no other reading can win: no single candidate does,
    and its n-grams as they stand are likelier together than the two least unlikely misreadings.
    """
    pairs = [stream(t) for t in texts]
    row, _, grams = packed([s for s, _ in pairs])
    found: list[dict[int, str]] = [{} for _ in texts]
    if not len(grams):
        return found
    last = (grams & np.uint64(0xFFFF)).astype(np.uint32)
    odds = _log_odds(channel)
    places = np.flatnonzero(np.isin(last, np.array(sorted(odds), dtype=np.uint32)))
    if not len(places):
        return found
    starts = np.cumsum([0, *(len(s) for s, _ in pairs)])
    ends = np.minimum(places + ORDER, starts[row[places] + 1])
    touched = np.zeros(len(grams) + 1, dtype=np.int64)
    np.add.at(touched, places, 1)
    np.add.at(touched, ends, -1)
    inside = np.flatnonzero(np.cumsum(touched)[:-1] > 0)
    logs = np.zeros(len(grams) + 1)
    logs[inside] = scorer.log(grams[inside])
    sums = np.concatenate([[0.0], np.cumsum(-logs[:-1])])
    # Each candidate by itself: by how much the n-grams round its place are likelier with it.
    gain: dict[int, list[tuple[float, int]]] = {}
    for x, meant in odds.items():
        mine = np.flatnonzero(last[places] == x)
        for m, o in meant if len(mine) else ():
            hopeful = mine[sums[ends[mine]] - sums[places[mine]] + o > 0] if not scorer.asking else mine
            if not len(hopeful):
                continue
            total = np.full(len(hopeful), o)
            for shift in range(ORDER):
                at = places[hopeful] + shift
                ok = np.flatnonzero(at < ends[hopeful])
                changed = grams[at[ok]] ^ (np.uint64(x ^ m) << np.uint64(16 * shift))
                total[ok] += scorer.log(changed) - logs[at[ok]]
            for p, g in zip(places[hopeful].tolist(), total.tolist()):
                gain.setdefault(p, []).append((g, m))
    # Places that share an n-gram, of one text, stand together.
    apart = (np.diff(places) >= ORDER) | (np.diff(row[places]) != 0)
    edges = np.concatenate([[0], np.flatnonzero(apart) + 1, [len(places)]])
    sizes = np.diff(edges)
    for k in np.flatnonzero(sizes == 1) if not scorer.asking else ():
        p = int(places[edges[k]])
        g, m = max(gain.get(p, [(0.0, 0)]))
        if g > 0:
            r = int(row[p])
            found[r][int(pairs[r][1][p - starts[r]])] = chr(m)
    for k in np.flatnonzero(sizes > 1):
        group = places[edges[k] : edges[k + 1]].tolist()
        a, z = group[0], int(ends[edges[k + 1] - 1])
        cheapest = sorted(max(o for _, o in odds[int(last[p])]) for p in group)[-2:]
        if not scorer.asking and sums[z] - sums[a] + sum(cheapest) <= 0 and not any(g > 0 for p in group for g, _ in gain.get(p, ())):
            continue
        r = int(row[a])
        base = int(starts[r])
        unit = last[base : starts[r + 1]]
        options = {p - base: [(int(last[p]), 0.0), *odds[int(last[p])]] for p in group}
        for i, c in zip(range(a - base, z - base), viterbi(scorer, unit, options, a - base, z - base)):
            if c != unit[i]:
                found[r][int(pairs[r][1][i])] = chr(c)
    return found


def _skeleton(word):
    """A word with characters and pairs of them that are misread for one another in one form (as a Column)."""
    s = word
    for read, meant in (("cl", "d"), ("rn", "m"), ("vv", "w")):
        s = F.replace(s, F.lit(read), F.lit(meant))
    return F.translate(s, "ei1I0h658", "clllobbsB")


def _misread_words(pages: DataFrame) -> DataFrame:
    """(i, field, meant): of rows that have misread Latin words or numbers a map from each to the word it stands for.

    Words with one skeleton are candidates for one another, so no word is expanded and none is too long. The most frequent one
    of a skeleton is meant by the others that it outweighs by the odds of the channel, unless they are too far apart; a word mostly of
    digits means a number if numbers of its form outweigh it. Words are compared by their true counts over all texts, rare ones too, and by joins,
    so no vocabulary has to fit anywhere.
    """
    digits, alpha = F.col("w").rlike("^[0-9]+$"), F.col("w").rlike("^[A-Za-z]{3,}$")
    shape = lambda c: F.regexp_replace(c, "[0-9]", "0")
    found = F.regexp_extract_all("body", F.lit("((?<![A-Za-z0-9])[A-Za-z0-9]{2,}(?![A-Za-z0-9]))"), F.lit(1))
    filled = pages.where("body is not null")
    counted = cut(filled.select(F.explode(found).alias("w")).groupBy(F.when(digits, shape(F.col("w"))).otherwise(F.col("w")).alias("w")).agg(F.count(F.lit(1)).alias("n")))
    n_digits = F.char_length(F.regexp_replace("w", "[^0-9]", ""))
    mixed = F.col("w").rlike("[A-Za-z]")
    shapes = counted.groupBy(shape(F.col("w")).alias("shape")).agg(F.sum("n").alias("n"))
    own = counted.where(mixed).withColumn("shape", shape(F.col("w"))).join(shapes.withColumnRenamed("n", "own"), "shape").select("w", "own", n_digits.alias("d"))
    outweighs = F.col("k") * CHANNEL > F.col("own") * (1 - CHANNEL)
    size = F.char_length("w")
    best = counted.where(alpha).groupBy(_skeleton(F.col("w")).alias("bones")).agg(F.max(F.struct("n", "w")).alias("top")).select("bones", F.col("top.w").alias("c"), F.col("top.n").alias("k"))
    words = own.where(F.col("d") * 2 < size).withColumn("bones", _skeleton(F.col("w"))).join(best, "bones").where((F.col("w") != F.col("c")) & outweighs).where(F.levenshtein("w", "c", 4) >= 0).select("w", "c")
    number = F.translate("w", "OolIZSB", "0011258")
    figures = own.where(F.col("d") * 2 >= size).withColumn("c", number).where(F.col("c").rlike("^[0-9]{3,}$")).withColumn("shape", shape(F.col("c"))).join(shapes.withColumnRenamed("n", "k"), "shape").where(outweighs).select("w", "c")
    meant = cut(words.unionByName(figures))
    rows = filled.select("i", "field", F.explode(F.array_distinct(found)).alias("w")).where(mixed)
    return rows.join(meant, "w").groupBy("i", "field").agg(F.map_from_entries(F.collect_set(F.struct("w", "c"))).alias("meant"))


def replaced_words(text: str, meant: dict[str, str]) -> list[tuple[int, int, str]]:
    """(start, end, word) of the words of a text that mean another one."""
    return [(*m.span(), meant[m[0]]) for m in _LATIN_WORD.finditer(text) if m[0] in meant] if meant else []


def repair_scans(df: DataFrame, row_id: str, text: str, title: str, company: str, source_file: str, most_entries: int | None = None) -> DataFrame:
    """(row_id, field_name, repaired, kinds): for every row its ``text`` and ``chapter_title`` repaired, and the noise found.

    First the structure of the page is undone: lines that are page numbers or running headers are dropped, words divided over
    two lines are rejoined, and the lines of a paragraph made continuous. From what is left Spark counts character n-grams, fits
    a modified Kneser-Ney model of texts and one of titles, estimates the probability of each confusion of two characters, and counts all Latin words.
    Misread characters are then corrected by the noisy channel: the probability of the misreading times the likelihood of the text,
    decoded by Viterbi over the candidates of a line; Latin words and numbers are chosen among words of the same skeleton by their
    frequency. A model of more than ``most_entries`` n-grams (BROADCAST_ENTRIES by default) isn't broadcast; the n-grams needed are joined instead, with the same result.

    Null texts and titles come out as null and without noise, empty ones empty. Repeated rows come out as often as they stand.
    A null company or file name leaves the other, or general forms of names. An empty table gives no rows. Other columns are
    ignored.
    """
    spark = df.sparkSession
    id_type = df.schema[row_id].dataType.simpleString()
    plain = df.select(*[F.col(c).alias(n) for c, n in ((row_id, "i"), (text, "t"), (title, "h"), (company, "c"), (source_file, "f"))])
    plain = spread(plain, "i")

    def structure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t, h, c, f in pdf[["i", "t", "h", "c", "f"]].itertuples(index=False):
                names = company_names(c, f)
                head, kinds = clean_title(h, names)
                rows.append((i, "chapter_title", None if h is None else head, sorted(kinds)))
                chapter = _MARKER.sub("", _squeezed(head))
                body, kinds = page_structure(t, names, chapter) if t else (t, set())
                rows.append((i, "text", body, sorted(kinds)))
            yield pd.DataFrame(rows, columns=["i", "field", "body", "kinds"])

    pages = cut(plain.mapInPandas(structure, f"i {id_type}, field string, body string, kinds array<string>"))
    grams = cut(count_grams(pages, lambda t: stream(t)[0], "field", "body"))
    channel, clean = learned_confusions(grams)
    tables = fit(clean)
    models = arrays(tables, most_entries)
    whole = models is not None
    shared = spark.sparkContext.broadcast(models)
    del models
    words = _misread_words(pages).withColumnsRenamed({"i": "w_i", "field": "w_field"})
    pages = pages.join(words, F.col("i").eqNullSafe(F.col("w_i")) & (F.col("field") == F.col("w_field")), "left").drop("w_i", "w_field")
    if not whole:
        # The model is too large to be broadcast: every text asks for the n-grams it needs, and the answers are joined.
        ask = F.pandas_udf(_asked(channel), "array<long>").asNondeterministic()
        pages = cut(pages.withColumn("k", F.xxhash64("body", "field")))
        needed = pages.dropDuplicates(["k"]).select("k", F.col("field").alias("lang"), F.explode(ask("body")).alias("gram"))
        needed = cut(needed)
        told = needed.join(look_up(needed, tables), ["lang", "gram"]).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("gram", "p"))).alias("known"))
        pages = pages.join(told, "k", "left").drop("k")
    else:
        pages = pages.withColumn("known", F.lit(None).cast("map<bigint,double>"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in sub_batches(batch, "body", 300_000):
                bodies, kinds, meant = list(pdf["body"]), [set(k) for k in pdf["kinds"]], [dict(m) if m is not None else {} for m in pdf["meant"]]
                changes: list[dict[int, str]] = [{} for _ in bodies]
                for field in ("text", "chapter_title"):
                    mine = [k for k, f in enumerate(pdf["field"]) if f == field and bodies[k]]
                    if shared.value is None:
                        for k in mine:
                            changes[k] = correct_characters(Scorer(known=dict(pdf["known"].iloc[k] or {})), [bodies[k]], channel)[0]
                    elif mine and field in shared.value:
                        for k, found in zip(mine, correct_characters(Scorer(shared.value[field]), [bodies[k] for k in mine], channel)):
                            changes[k] = found
                for k, b in enumerate(bodies):
                    edits = [(a, a + 1, c) for a, c in changes[k].items()] + (replaced_words(b, meant[k]) if b else [])
                    if edits:
                        kinds[k].add("ocr_char")
                        for a, z, c in sorted(edits, reverse=True):
                            b = b[:a] + c + b[z:]
                        bodies[k] = b
                yield pd.DataFrame({"i": pdf["i"], "field_name": pdf["field"], "repaired": bodies, "kinds": [sorted(k) for k in kinds]})

    out = pages.mapInPandas(decode, f"i {id_type}, field_name string, repaired string, kinds array<string>")
    return out.withColumnRenamed("i", row_id)


def _asked(channel: dict[str, dict[str, float]]):
    """The n-grams that decoding each text of a batch needs."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for t in s:
                scorer = Scorer()
                if t:
                    correct_characters(scorer, [t], channel)
                out.append(sorted(scorer.asked))
            yield pd.Series(out, dtype=object)

    return run
