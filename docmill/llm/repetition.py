"""Repetition inside a single document by n-gram perplexity with a memory of the document (problem 1)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.ngram import FLOOR, count_grams, fit, frequent, packed
from docmill.llm.rolling import code_points, folded_table, mix, sub_batches, windows
from docmill.session import cut, spread

# The frame of a model reply, which isn't content.
FRAME = re.compile(
    r'"?[\s{}\[\],:]*"(?:standards|entity|type|status|evidence)"\s*:\s*[\[{]*\s*"?|"?\b(?:TYPE_[A-D]|ADOPTED|PENDING)\b"?|"?\bNO"(?=\s*[,}])|"\s*\}[\s\]},]*|\n?\.\.\.\[truncated \d+ chars\]\.\.\.\n?|```(?:json)?'
)
#: Letters that must be the same for a stretch to count as repeated.
SPAN = 12
#: Characters of the document's own text that its memory looks back on.
MEMORY = 6
#: The bands lie at these multiples of the upper quartile of the surprise (nats a character) that new text of the language has.
#: A text of which more than half repeats has at most some 0.65 times the surprise of its new part, so that it is under the lower
#: band unless its new part is over the upper one.
LOWER, UPPER = 0.9, 1.2
_MEMORY_WEIGHT = 0.95
# Frequent words that tell languages of the Latin script apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with was on as by from which this are".split(), "de": "der die das und ist nicht mit von den dem ein eine zu auf für werden".split(),
    "fr": "le la les des et est une dans pour par sur que qui du au avec".split(), "es": "el los las y es una en por para que del con se su como".split(),
    "pt": "o os as e é uma em por para que do da com não no na".split(), "it": "il lo gli e è una in per che di del della con non sono".split(), "nl": "de het een en is van voor met niet op te dat zijn door aan".split(),
}
# Scripts by range of letters and the language they stand for.
SCRIPTS = ((0x3040, 0x30FF, "ja"), (0xAC00, 0xD7A3, "ko"), (0x0400, 0x052F, "ru"), (0x0370, 0x03FF, "el"), (0x0590, 0x05FF, "he"), (0x0600, 0x06FF, "ar"), (0x0900, 0x097F, "hi"), (0x0E00, 0x0E7F, "th"), (0x3400, 0x9FFF, "zh"))


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: what is shown of it (0 for spaces), its kind (1 letter, 0 other), and its script (see SCRIPTS; 0 none, 1 another)."""
    codes = np.arange(0x110000)
    table = folded_table()
    digit = (table >= 48) & (table <= 57)
    letter = (table > 0) & ~digit
    shown = np.where(table > 0, table, codes).astype(np.uint32)
    shown[digit] = 48
    shown[:33] = shown[0x3000] = shown[0xA0] = 0
    script = letter.astype(np.int8)
    for k, (lo, hi, _) in enumerate(SCRIPTS, 2):
        script[lo : hi + 1] = np.where(letter[lo : hi + 1], k, 0)
    return shown, letter.astype(np.int8), script


def content(text: str, frame: re.Pattern | None = FRAME) -> tuple[np.ndarray, np.ndarray]:
    """(characters, kind) of a text without its frame and without spaces: letters folded, each digit as 0.

    kind is 1 for letters and 0 for digits and punctuation.
    """
    return read_text(text, frame)[1:]


def read_text(text: str, frame: re.Pattern | None = FRAME) -> tuple[str, np.ndarray, np.ndarray]:
    """(language, characters, kind) of a text."""
    plain = frame.sub(" ", text) if frame else text
    codes = code_points(plain)
    shown, letter, script = _classes()
    out = shown[codes]
    keep = out > 0
    return _language(plain, script[codes]), out[keep], letter[codes][keep]


def language(text: str) -> str:
    """The language of a text: by its script, and by frequent words for the Latin script (``latin`` if it has none)."""
    return read_text(text, None)[0]


def _language(text: str, scripts: np.ndarray) -> str:
    counts = np.bincount(scripts, minlength=len(SCRIPTS) + 2)[1:]
    if not (total := counts.sum()):
        return "none"
    if counts[1] >= 0.1 * total:  # kana stand among ideographs
        return SCRIPTS[0][2]
    best = int(counts[1:].argmax())
    if counts[1 + best] >= 0.3 * total:
        return SCRIPTS[best][2]
    words = Counter(re.findall(r"[^\W\d_]+", text.lower()))
    found = {name: sum(words[w] for w in known) for name, known in FUNCTION_WORDS.items()}
    top = max(found, key=lambda k: found[k])
    return top if found[top] else "latin"


def _grouped(hashes: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of hash and place, hashes in that order). Where places fit into ``most_bits`` they are packed below the hash,
    as sorting single numbers is many times faster than finding their order; the hash then has as many bits fewer."""
    bits = max(1, int(len(hashes) - 1).bit_length()) if len(hashes) else 1
    if bits > most_bits:
        order = np.argsort(hashes, kind="stable")
        return order, hashes[order]
    low = np.uint64((1 << bits) - 1)
    packed_ = np.sort((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64))
    return (packed_ & low).astype(np.int64), packed_ & ~low


def _covered(codes: np.ndarray, length: int, where: np.ndarray | None = None) -> np.ndarray:
    """Which characters lie in a window that stands earlier too; ``where`` gives the beginnings of the windows that count."""
    if len(codes) < length or where is not None and not len(where):
        return np.zeros(len(codes), dtype=bool)
    h = windows(codes, length)
    order, s = _grouped(h if where is None else h[where], 12)
    again = order[1:][s[1:] == s[:-1]]
    if where is not None:
        again = where[again]
    n = len(codes) + 1
    return np.cumsum(np.bincount(again, minlength=n)[:n] - np.bincount(again + length, minlength=n)[:n])[:-1] > 0


def repeated_share(text: str | None, frame: re.Pattern | None = FRAME, span: int = SPAN) -> float:
    """The share of a text's content that repeats earlier text of it, whatever the digits, spaces and punctuation.

    A letter is repeated if it lies in ``span`` letters that stand earlier; digits and punctuation are if the letters around
    them are, or if they lie in ``span`` characters that stand earlier as they are (a run of commas). 0 for null or empty.
    """
    return share_of(*content(text, frame), span) if text else 0.0


def share_of(codes: np.ndarray, kind: np.ndarray, span: int = SPAN) -> float:
    """repeated_share of what content gives."""
    if not len(codes):
        return 0.0
    letters = np.flatnonzero(kind == 1)
    hit = np.zeros(len(codes), dtype=bool)
    hit[letters] = _covered(codes[letters], span)
    if len(letters):
        before = np.searchsorted(letters, np.arange(len(codes)), "right") - 1
        after = np.minimum(before + 1, len(letters) - 1)
        hit |= (kind == 0) & (before >= 0) & hit[letters[np.maximum(before, 0)]] & hit[letters[after]]
    # Only windows without letters: what holds letters has been judged on the letters.
    before = np.concatenate([[0], np.cumsum(kind, dtype=np.int64)])
    hit |= _covered(codes, span, np.flatnonzero(before[span:] == before[:-span]) if len(codes) >= span else None)
    return float(hit.mean())


def _rank(keys: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each."""
    order, s = _grouped(keys, 20)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    start = np.repeat(first, np.diff(np.concatenate([first, [len(s)]])))
    out = np.empty(len(s), dtype=np.int64)
    out[order] = np.arange(len(s)) - start
    return out


def memory_probability(streams: list[np.ndarray], row: np.ndarray, at: np.ndarray, length: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(probability, known): of each character after its last ``length`` - 1, by the earlier text of its own document."""
    codes = np.concatenate(streams) if len(row) else np.zeros(0, np.uint32)
    full, head = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    for n, out, shift in ((length, full, 0), (length - 1, head, 1)):
        h = windows(codes, n)
        ends = np.arange(len(h)) + n - 1 + shift
        ok = ends < len(codes)
        ends, h = ends[ok], h[ok]
        inside = (at[ends] >= n - 1 + shift) & (row[ends] == row[ends - n + 1 - shift])
        ends, h = ends[inside], h[inside]
        out[ends] = _rank(mix(h ^ mix(row[ends].astype(np.uint64))))
    known = head > 0
    return np.where(known, full / np.maximum(head, 1), 0.0), known


def foreseen(contents: list[tuple[np.ndarray, np.ndarray]], row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability, known) of each character by the memory of its own document, whatever the digits and punctuation (as in share_of).

    Letters are foreseen by the letters before them alone. Digits and punctuation are as far as the letters on both sides of
    them are, or as far as the characters before them, as they are, foresee them.
    """
    streams = [codes for codes, _ in contents]
    p, known = memory_probability(streams, row, at)
    kind = np.concatenate([k for _, k in contents]) if len(row) else np.zeros(0, np.int8)
    letters = np.flatnonzero(kind == 1)
    if not len(letters):
        return p, known
    mine = row[letters]
    first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
    nth = np.arange(len(letters)) - np.repeat(first, np.diff(np.concatenate([first, [len(letters)]])))
    p[letters], known[letters] = memory_probability([codes[k == 1] for codes, k in contents], mine, nth)
    other = np.flatnonzero(kind != 1)
    after = np.searchsorted(letters, other)
    between = (after > 0) & (after < len(letters))
    other, a, b = other[between], letters[after[between] - 1], letters[after[between]]
    same = (row[a] == row[other]) & (row[b] == row[other]) & known[a] & known[b]
    other, a, b = other[same], a[same], b[same]
    p[other] = np.maximum(p[other], np.minimum(p[a], p[b]))
    known[other] = True
    return p, known


def repetition(df: DataFrame, row_id: str, text: str, frame: re.Pattern | None = None) -> DataFrame:
    """(row_id, lang, n_chars, log_ppl, memory_log_ppl, lower, upper, band, repeated_share) of every text.

    Spark counts the character n-grams of all texts and fits a modified Kneser-Ney model of each language. The most frequent n-grams
    are broadcast in sorted arrays; the others, if there are any, are joined, so that none is left out. ``log_ppl`` is the mean
    surprise (nats a character) under that model, ``memory_log_ppl`` under its mixture with the n-grams that the same text had
    before, which a loop makes almost certain, whatever its digits and punctuation.
    Bands of each language follow from all its texts, from the surprise of those characters that their own document's
    memory didn't foresee, as loops would pull down the rest: band is ``low`` (loops) if memory_log_ppl is under ``LOWER``
    times the upper quartile, ``high`` (garbage) if log_ppl is over ``UPPER`` times it, else ``ok``.
    ``repeated_share`` is measured exactly on every text, of any length. What ``frame`` matches (such as FRAME, the frame of a JSON reply) isn't content.

    Null and empty texts, and texts without content, have the band ok and the share 0. Repeated rows come out as often as they
    stand. An empty table gives no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    id_type = df.schema[row_id].dataType.simpleString()
    plain = spread(df.select(F.col(row_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")), "i")

    def language_and_stream(t: str) -> tuple[str, np.ndarray]:
        return read_text(t, frame)[:2]

    table = fit(count_grams(plain.where("t <> ''"), language_and_stream, None, "t"))[-1]
    known_grams, complete = frequent(table)
    shared = spark.sparkContext.broadcast(known_grams)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for batch in batches for part in sub_batches(batch, "t")):
            read = [read_text(t, frame) for t in pdf["t"]]
            contents, langs = [x[1:] for x in read], np.array([x[0] for x in read], dtype=object)
            streams = [codes for codes, _ in contents]
            row, at, gram = packed(streams)
            p, found = np.full(len(gram), FLOOR), np.zeros(len(gram), dtype=bool)
            for name, (keys, probs) in shared.value.items():
                mine = np.flatnonzero((langs == name)[row]) if len(row) else np.zeros(0, np.int64)
                place = np.minimum(np.searchsorted(keys, gram[mine]), len(keys) - 1)
                hit = keys[place] == gram[mine]
                p[mine[hit]], found[mine[hit]] = probs[place[hit]], True
            memory, known = foreseen(contents, row, at)
            mixed = np.where(known, (1 - _MEMORY_WEIGHT) * p + _MEMORY_WEIGHT * memory, p)
            told = np.ones(len(gram), dtype=bool) if complete else found
            fresh = memory < 0.5  # what the document's memory didn't foresee
            total = lambda x, where: np.bincount(row[where], weights=-np.log(x[where]), minlength=len(streams))
            opens: list[list[dict]] = [[] for _ in streams]
            for k in np.flatnonzero(~told):
                opens[row[k]].append({"gram": int(gram[k].view(np.int64)), "memory": float(memory[k]) if known[k] else -1.0})
            yield pd.DataFrame({
                "i": pdf["i"], "k": pdf["k"], "lang": langs, "n_chars": np.array([len(s) for s in streams], dtype=np.int32), "n_fresh": np.bincount(row[fresh], minlength=len(streams)), "plain": total(p, told), "mixed": total(mixed, told),
                "fresh": total(p, told & fresh), "repeated_share": [share_of(*c) for c in contents], "opens": opens,
            })

    schema = f"i {id_type}, k long, lang string, n_chars int, n_fresh long, plain double, mixed double, fresh double, repeated_share double, opens array<struct<gram:long,memory:double>>"
    scored = cut(plain.select("i", "t", F.xxhash64("t").alias("k")).mapInPandas(score, schema))
    if not complete:
        asked = scored.dropDuplicates(["k"]).select("k", "lang", F.explode("opens").alias("o")).select("k", "lang", "o.gram", "o.memory").join(table.select("lang", "gram", "p"), ["lang", "gram"])
        known = F.col("memory") >= 0
        both = F.when(known, (1 - _MEMORY_WEIGHT) * F.col("p") + _MEMORY_WEIGHT * F.col("memory")).otherwise(F.col("p"))
        rest = asked.groupBy("k").agg(F.sum(-F.log("p")).alias("plain2"), F.sum(-F.log(both)).alias("mixed2"), F.sum(F.when(F.greatest("memory", F.lit(0.0)) < 0.5, -F.log("p")).otherwise(0.0)).alias("fresh2"))
        scored = scored.join(rest, "k", "left").na.fill(0.0, ["plain2", "mixed2", "fresh2"])
        scored = scored.select(*[c for c in scored.columns if c not in ("plain", "mixed", "fresh", "plain2", "mixed2", "fresh2")], *[(F.col(c) + F.col(f"{c}2")).alias(c) for c in ("plain", "mixed", "fresh")])
    n = F.greatest("n_chars", F.lit(1))
    scored = scored.withColumns({"log_ppl": F.col("plain") / n, "memory_log_ppl": F.col("mixed") / n, "new": F.col("fresh") / F.greatest("n_fresh", F.lit(1))})
    # One row a language.
    quartile = F.percentile_approx("new", 0.75, 1000)
    bands = scored.where("n_fresh > 0").groupBy("lang").agg((quartile * LOWER).alias("lower"), (quartile * UPPER).alias("upper"))
    band = F.when((F.col("n_chars") == 0) | F.col("lower").isNull(), "ok").when(F.col("memory_log_ppl") < F.col("lower"), "low").when(F.col("log_ppl") > F.col("upper"), "high").otherwise("ok")
    return scored.join(F.broadcast(bands), "lang", "left").select(F.col("i").alias(row_id), "lang", "n_chars", "log_ppl", "memory_log_ppl", "lower", "upper", band.alias("band"), "repeated_share")
