"""Structured replies of a model: parsing, validation, repair, degeneration and grounding."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.norm import grounded, head_and_tail

# Fixed values.
TYPES, STATUSES = ("TYPE_A", "TYPE_B", "TYPE_C", "TYPE_D"), ("ADOPTED", "PENDING", "NO")
FIELDS = ("entity", "type", "status", "evidence")
NOTHING = {"entity": "无", "type": "TYPE_D", "status": "NO", "evidence": "未发现相关描述"}
MIN_BYTES, MAX_RATIO = 1000, 0.20
RELEVANCE = ("related", "unrelated", "uncertain")
_ITEMS = "array<struct<entity:string,type:string,status:string,evidence:string>>"
_DECODER = json.JSONDecoder()


# A fence round a whole reply, and fences anywhere.
WHOLE_FENCE, ANY_FENCE = re.compile(r"```(?:json)?\s*\n(.*?)\n```\s*$", re.S), re.compile(r"(?m)^```(?:json)?\s*|```$")


def unfenced(raw: str) -> str:
    """The inside of a fence round the whole reply, else the reply without fences."""
    text = raw.strip()
    whole = WHOLE_FENCE.match(text)
    return (whole[1] if whole else ANY_FENCE.sub("", text)).strip()


def first_object(raw: str) -> Any:
    """The first JSON object that can be decoded, wherever it begins; raises ValueError if there is none."""
    s = ANY_FENCE.sub("", (raw or "").strip()).strip()
    at = s.find("{")
    while at >= 0:
        try:
            return _DECODER.raw_decode(s, at)[0]
        except ValueError:
            at = s.find("{", at + 1)
    raise ValueError("no JSON object")


def whole_object(raw: str) -> dict:
    """The whole text as one JSON object with ``standards``; raises ValueError otherwise."""
    data = json.loads(unfenced(raw))
    if not isinstance(data, dict) or "standards" not in data:
        raise ValueError("not an object with standards")
    return data


@dataclass(frozen=True)
class Rule:
    """What a value of a reply must be: its type, its keys or its items, and the values it may have."""

    kind: type
    keys: dict[str, Rule] = field(default_factory=dict)
    items: Rule | None = None
    values: tuple[str, ...] = ()

    def errors(self, value: Any, where: str = "reply") -> Iterator[str]:
        """What is wrong with a value, by its place."""
        if not isinstance(value, self.kind):
            yield f"{where}: {type(value).__name__} instead of {self.kind.__name__}"
            return
        if self.values and value not in self.values:
            yield f"{where}: {value} is unknown"
        if self.keys:
            yield from (f"{where}: unexpected {k}" for k in sorted(value.keys() - self.keys.keys()))
            yield from (f"{where}: {k} is missing" for k in self.keys if k not in value)
            for k, rule in self.keys.items():
                if k in value:
                    yield from rule.errors(value[k], f"{where}.{k}")
        for i, x in enumerate(value if self.items else ()):
            yield from self.items.errors(x, f"{where}[{i}]")


REPLY = Rule(dict, {"standards": Rule(list, items=Rule(dict, {"entity": Rule(str), "type": Rule(str, values=TYPES), "status": Rule(str, values=STATUSES), "evidence": Rule(str)}))})


def json_schema(rule: Rule = REPLY) -> dict:
    """The rules as a JSON schema, for engines with structured output."""
    if rule.kind is dict:
        return {"type": "object", "properties": {k: json_schema(r) for k, r in rule.keys.items()}, "required": [*rule.keys], "additionalProperties": False}
    if rule.kind is list:
        return {"type": "array", "items": json_schema(rule.items)}
    return {"type": "string"} | ({"enum": [*rule.values]} if rule.values else {})


def payload_errors(data: Any) -> list[str]:
    """What a parsed reply has against the rules."""
    return list(REPLY.errors(data))


# What is wrong between two tokens of JSON and what belongs there.
REPAIRS = (("removed_trailing_comma", re.compile(r",(\s*[}\]])"), r"\1"), ("normalized_fullwidth_punctuation", re.compile(r'("\s*)：(\s*")'), r"\1:\2"), ("normalized_fullwidth_punctuation", re.compile(r'(["}\]\d])\s*，\s*([\["{\-\d])'), r"\1,\2"))


def repaired(raw: str) -> tuple[str, list[str]]:
    """(text, actions): fences, trailing commas, and full-width colons and commas between values undone."""
    text = unfenced(raw)
    actions = ["removed_markdown_fence"] if text != raw else []
    for name, pattern, to in REPAIRS:
        text, n = pattern.subn(to, text)
        if n and name not in actions:
            actions.append(name)
    return text, actions


def parse_reply(raw: str | None) -> dict:
    """method (strict, repaired or none), items, errors and actions of a reply."""
    out: dict = {"method": "none", "items": None, "errors": [], "actions": []}
    if not raw:
        return out | {"errors": ["empty"]}
    text, actions = raw, []
    for method in ("strict", "repaired"):
        try:
            if method == "repaired":
                text, actions = repaired(raw)
            data = whole_object(text)
        except (ValueError, RecursionError) as e:
            out["errors"] = [type(e).__name__]
            continue
        if errors := payload_errors(data):
            out["errors"] = errors
            continue
        return {"method": method, "items": [{f: x[f] for f in FIELDS} for x in data["standards"]], "errors": [], "actions": actions}
    return out


def lenient_items(raw: str | None) -> list[dict] | None:
    """Items of the first object anywhere in a reply, with defaults for what is missing or unknown; null if there is none."""
    try:
        data = first_object(raw or "")
    except (ValueError, RecursionError):
        return None
    items = data.get("standards") if isinstance(data, dict) else data
    if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
        return None
    known = {"type": TYPES, "status": STATUSES}
    out = []
    for x in items:
        row = {}
        for f in FIELDS:
            v = str(x.get(f) or NOTHING[f]).strip()
            v = v.upper() if f in known else v
            row[f] = v if v and (f not in known or v in known[f]) else NOTHING[f]
        out.append(row)
    return out or [dict(NOTHING)]


def strict_reply(raw: Column) -> Column:
    """parse_reply as a Column: struct(method, items, errors, actions)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([parse_reply(x) for x in s], columns=["method", "items", "errors", "actions"])

    return F.pandas_udf(run, f"method string, items {_ITEMS}, errors array<string>, actions array<string>")(raw)


def lenient_reply(raw: Column) -> Column:
    """lenient_items as a Column."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([lenient_items(x) for x in s], dtype=object)

    return F.pandas_udf(run, _ITEMS)(raw)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _segment_repeats(line: str, least: int, times: int) -> bool:
    """Whether a line holds ``times`` copies in a row of a segment of at least ``least`` characters, of any length.

    A stretch of ``times`` copies of a segment of length p holds a multiple of p as a place from which the next ``least``
    characters stand again p later. These places, n / p of them for each p, are compared by hash; only for lengths with such a
    place is the stretch measured.
    """
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = len(codes)
    if n < least * times:
        return False
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - least, _STEP)]), dtype=np.uint64)
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(pow(int(_STEP), -1, 1 << 64)))]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(0x5851F42D4C957F2D)) * inverse, dtype=np.uint64)])
        windows = (sums[least:] - sums[: n - least + 1]) * powers
    for p in range(least, n // times + 1):
        at = np.arange(0, n - least - p + 1, p)
        if (windows[at] == windows[at + p]).any():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], (codes[:-p] == codes[p:]).astype(np.int8), [0]])))
            if len(edges) and (edges[1::2] - edges[::2]).max() >= (times - 1) * p:
                return True
    return False


def long_segment_repeats(text: str | None, least: int = 80, times: int = 5) -> bool:
    """Whether a segment of at least ``least`` characters, of any length, stands ``times`` times in a row within a line."""
    return bool(text) and any(_segment_repeats(line, least, times) for line in text.split("\n"))


def degeneration_flags(raw: Column, min_bytes: int = MIN_BYTES, max_ratio: float = MAX_RATIO) -> Column:
    """Flags of a looping reply: compression_ratio_X, single_char_repeat, long_segment_repeat; empty for nulls.

    Compression and long segments need Python: of replies of ``min_bytes`` and more, and of those long enough for five segments.
    """

    def ratios(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if x is None else len(zlib.compress(b := x.encode(), 6)) / len(b) for x in s], dtype="float64")

    def segments(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(long_segment_repeats).astype(bool)

    ratio = F.pandas_udf(ratios, "double")(F.when(F.octet_length(raw) >= min_bytes, raw))
    return F.array_compact(
        F.array(
            F.when(ratio < max_ratio, F.format_string("compression_ratio_%.3f", ratio)),
            F.when(raw.rlike(r"([\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}])\1{29}"), F.lit("single_char_repeat")),
            F.when(F.pandas_udf(segments, "boolean")(F.when(F.char_length(raw) >= 400, raw)), F.lit("long_segment_repeat")),
        )
    )


def entity_rows(units: DataFrame, items: str) -> DataFrame:
    """The unit columns with entity, type, status and evidence: one row for each item, one of nothing for null or empty."""
    none = F.array(F.struct(*[F.lit(NOTHING[f]).alias(f) for f in FIELDS]))
    keep = [c for c in units.columns if c != items and c not in FIELDS]
    return units.select(*keep, F.inline(F.when(F.size(items) > 0, F.col(items)).otherwise(none)))


def grounding(df: DataFrame, entity: str, evidence: str, source: str) -> DataFrame:
    """df with entity_grounded and evidence_grounded: whether they stand in the source text."""
    return df.withColumn("entity_grounded", grounded(F.col(entity), F.col(source))).withColumn("evidence_grounded", grounded(F.col(evidence), F.col(source)))


def screening_reply(raw: Column) -> Column:
    """struct(relevance, confidence_score, reason, status) of a relevance reply; broken JSON is read field by field.

    Unknown relevance is uncertain; the score is clamped to 0..1, unreadable ones and NaN are 0. Without a relevance the
    status is ERROR.
    """
    parsed = F.from_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), "relevance string, confidence_score string, reason string")
    field_of = lambda name: F.nullif(F.regexp_extract(raw, rf'"{name}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit(""))
    number = F.nullif(F.regexp_extract(raw, r'"confidence_score"\s*:\s*(-?\d+(?:\.\d+)?)', 1), F.lit(""))
    tail = F.regexp_replace(F.regexp_extract(raw, r'(?s)"reason"\s*:\s*"(.*)\}', 1), r'\s*"\s*$', "")
    # Escapes of JSON are undone by reading the fragment as a JSON string; one that can't be read stays as it is.
    inner = F.regexp_replace(tail, r'(?<!\\)"', r'\\"')
    undone = F.get(F.from_json(F.concat(F.lit('["'), inner, F.lit('"]')), "array<string>"), F.lit(0))
    rescued = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(undone, tail), r"\\[ntr]", " "), r"\s+", " "))
    ok = parsed["relevance"].isNotNull()
    relevance = F.lower(F.trim(F.when(ok, parsed["relevance"]).otherwise(field_of("relevance"))))
    score = F.when(ok, parsed["confidence_score"]).otherwise(number).try_cast("double")
    score = F.when(score.isNull() | F.isnan(score), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    status = F.when(relevance.isNull(), "ERROR").otherwise("OK")
    return F.struct(F.when(relevance.isin(*RELEVANCE), relevance).otherwise("uncertain").alias("relevance"), score.alias("confidence_score"), F.coalesce(F.when(ok, F.trim(parsed["reason"])).otherwise(rescued), F.lit("")).alias("reason"), status.alias("status"))


def audit_columns(df: DataFrame, raw: str) -> DataFrame:
    """df with raw_response_sha256, raw_response_length, raw_response_preview and degeneration_flags of a reply."""
    r = F.coalesce(F.col(raw), F.lit(""))
    return df.withColumn("raw_response_sha256", F.sha2(r, 256)).withColumn("raw_response_length", F.char_length(r)).withColumn("raw_response_preview", head_and_tail(F.col(raw))).withColumn("degeneration_flags", degeneration_flags(F.col(raw)))
