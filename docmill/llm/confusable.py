"""One consistent form for text that looks the same (problem 7)."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.session import cut

# Characters that are drawn like a Latin one. Greek, Cyrillic, Armenian, Cherokee and Lisu letters.
LOOK_ALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "α": "a", "υ": "u", "κ": "k", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "Ԛ": "Q", "Ԝ": "W", "ӏ": "l", "Ү": "Y",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ⅼ": "l", "Օ": "O", "Տ": "S", "Լ": "L", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "յ": "j",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "Ꭱ": "R",
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
}
# Hyphens and minus signs of another kind; dashes (— and –) are punctuation and stay.
HYPHENS = "\u2010\u2011\u2012\u2212\ufe63\uff0d\u2043"
# Characters without a width or a picture.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
# Spaces other than U+0020. Tab and line ends are layout and stay.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Full-width forms that become ASCII: letters, digits, slash, hyphen and their like, but not Chinese punctuation.
WIDE_KEPT = "！＂＇（），：；？［］｛｝～．"
# Radicals of the supplement and the ideographs drawn like them, as most have no decomposition.
RADICALS = {
    "⺀": "冫", "⺁": "厂", "⺂": "乛", "⺃": "乚", "⺄": "乙", "⺅": "亻", "⺆": "冂", "⺇": "𠘨", "⺈": "刀", "⺉": "刂", "⺊": "卜", "⺋": "㔾", "⺌": "小", "⺍": "小", "⺎": "兀", "⺏": "尣", "⺐": "尢", "⺑": "𡯂", "⺒": "巳", "⺓": "幺", "⺔": "彑", "⺕": "𫜹", "⺖": "忄", "⺗": "㣺", "⺘": "扌", "⺙": "攵", "⺛": "旡", "⺜": "日", "⺝": "月", "⺞": "歺", "⺟": "母", "⺠": "民", "⺡": "氵", "⺢": "氺", "⺣": "灬", "⺤": "爫", "⺥": "爫", "⺦": "丬", "⺧": "牛", "⺨": "犭", "⺩": "王", "⺪": "𤴔", "⺫": "罒", "⺬": "示", "⺭": "礻", "⺮": "𥫗", "⺯": "糹", "⺰": "纟", "⺱": "罓", "⺲": "罒", "⺳": "㓁", "⺴": "冗", "⺵": "𦉫", "⺶": "羊", "⺷": "𦍌", "⺸": "𦍋", "⺹": "耂", "⺺": "肀", "⺻": "聿", "⺼": "月", "⺽": "𦥑", "⺾": "艹", "⺿": "艹", "⻀": "艹", "⻁": "虎", "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻇": "𧢲", "⻈": "讠", "⻉": "贝", "⻊": "𧾷", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻏": "邑", "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻕": "𨸏", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻞": "𩙿", "⻟": "飠", "⻠": "饣", "⻡": "𩠐", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻫": "斉", "⻬": "齐", "⻭": "歯", "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻱": "龜", "⻲": "亀",
}
#: Letters of another script are only replaced in words that no letter proves to be of that script (see below).
_OTHER = "Ͱ-ϿЀ-ԯԱ-ևᎠ-Ᏽꓐ-ꓽ"
_SIGNS = "μΩ"
#: Signs that stay though Unicode knows another form: the ohm sign.
_KEPT = "\u2126"
#: Rows that may share a value before they are salted in the join with its form.
HOT_ROWS = 200_000


def _compatibility_letters() -> dict[str, str]:
    """Latin letters of another kind by the Unicode database: mathematical (with digits), circled and squared ones, ligatures.

    Circled digits, superscripts, Roman numerals, ℓ and ℹ are ordinary signs and stay.
    """
    found = {}
    for code in range(0x80, sys.maxunicode + 1):
        kind, to = unicodedata.decomposition(chr(code)).partition(" ")[0], unicodedata.normalize("NFKC", chr(code))
        if kind in ("<font>", "<circle>", "<square>") and len(to) == 1 and to.isascii() and (to.isalpha() or kind == "<font>" and to.isdigit()) or 0xFB00 <= code <= 0xFB06:
            found[chr(code)] = to
    return {c: to for c, to in found.items() if c not in "ℓℹ"}


COMPATIBILITY_LETTERS = _compatibility_letters()


def _ideograph(code: int) -> bool:
    return 0x2E80 <= code <= 0x2FDF or 0xF900 <= code <= 0xFAFF or 0x2F800 <= code <= 0x2FA1F


def _unstable() -> dict[str, str]:
    """Characters that no composed text holds, with what stands for them, such as the signs for kelvin and ångström."""
    codes = (c for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and not _ideograph(c) and chr(c) not in _KEPT)
    return {chr(c): unicodedata.normalize("NFC", chr(c)) for c in codes if unicodedata.normalize("NFC", chr(c)) != chr(c)}


UNSTABLE = _unstable()


def mapping_table() -> list[tuple[str, str, str]]:
    """(character, replacement, kind) by rule from the Unicode database and fixed values; a few thousand rows, whatever the data.

    kind is ``space``, ``invisible``, ``hyphen``, ``wide``, ``ideograph``, ``compose`` (canonical decompositions of
    letters, undone by the recomposition), ``single`` (one character for another, equal one) or ``look``.
    """
    table: dict[str, tuple[str, str]] = {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or c in _KEPT:
            continue
        kind = unicodedata.decomposition(c)
        if not kind:
            continue
        if 0xFF01 <= code <= 0xFF5E and c not in WIDE_KEPT:
            table[c] = (unicodedata.normalize("NFKC", c), "wide")
        elif _ideograph(code):
            table[c] = (unicodedata.normalize("NFKC", c), "ideograph")
        elif not kind.startswith("<") and c not in _SIGNS and (len(full := unicodedata.normalize("NFD", c)) > 1 or c in UNSTABLE):
            table[c] = (full, "compose" if len(full) > 1 else "single")
    for c, to in RADICALS.items():
        table.setdefault(c, (to, "ideograph"))
    table |= {c: (" ", "space") for c in SPACES} | {c: ("", "invisible") for c in INVISIBLE} | {c: ("-", "hyphen") for c in HYPHENS}
    table |= {c: (to, "look") for c, to in (COMPATIBILITY_LETTERS | LOOK_ALIKES).items()}
    return sorted((c, to, kind) for c, (to, kind) in table.items())


def composition_table() -> list[tuple[str, str]]:
    """(starter and mark, composed character): the canonical compositions of two characters."""
    pairs = []
    for code in range(0xA0, sys.maxunicode + 1):
        c = chr(code)
        d = unicodedata.decomposition(c)
        if d and not d.startswith("<") and " " in d and unicodedata.normalize("NFC", c) == c and not 0xAC00 <= code <= 0xD7A3:
            pairs.append(("".join(chr(int(x, 16)) for x in d.split()), c))
    return sorted(pairs)


def mark_table() -> list[tuple[str, int, str, str]]:
    """(combining mark, its class, starters that compose with it, the composed characters in the same order)."""
    made: dict[str, list[tuple[str, str]]] = {}
    for pair, composed in composition_table():
        made.setdefault(pair[1], []).append((pair[0], composed))
    marks = (chr(c) for c in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(c)))
    return [(m, unicodedata.combining(m), "".join(a for a, _ in made.get(m, ())), "".join(b for _, b in made.get(m, ()))) for m in marks]


def _class(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)


def _ranges(chars) -> str:
    """A character class of many characters as few ranges."""
    codes = sorted(set(map(ord, chars)))
    starts = [c for c, before in zip(codes, [-1, *codes]) if c != before + 1]
    stops = [c for c, after in zip(codes, [*codes[1:], -1]) if after != c + 1]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, stops))


_FORMS = _ranges([*SPACES, *INVISIBLE, *HYPHENS, *(chr(c) for c in range(0xFF01, 0xFF5F) if chr(c) not in WIDE_KEPT), *COMPATIBILITY_LETTERS, *UNSTABLE, *"ıɡɑⅼ"])
_ODD = _FORMS + "\\x{2e80}-\\x{2fdf}\\x{f900}-\\x{faff}\\x{2f800}-\\x{2fa1f}"
#: Finds values that can change at all: any character of the mapping, or a combining mark.
SUSPICIOUS = f"[{_ODD}{_OTHER}\\p{{M}}]"
#: Anything but the characters that nearly all values are made of; a cheap test before SUSPICIOUS.
UNUSUAL = f"[^\\x{{9}}\\x{{a}}\\x{{d}}\\x{{20}}-\\x{{7e}}\\x{{3001}}-\\x{{3029}}一-鿿{WIDE_KEPT.replace('［', '').replace('］', '')}—…·“”‘’]"


def suspicious(value) -> Column:
    return value.rlike(UNUSUAL) & value.rlike(SUSPICIOUS)


_UNSEEN = f"[{_class(INVISIBLE)}]"
_MARKED = f"[^\\p{{M}}]?{_UNSEEN}*\\p{{M}}[\\p{{M}}{_class(INVISIBLE)}]*"  # a character with its marks
_LETTER = f"[{_OTHER}&&[^{_SIGNS}]]"
#: Words of another script that stand together, unless Latin letters touch them.
_WORDS = f"(?<![A-Za-z]){_LETTER}[{_OTHER} {_class(SPACES + INVISIBLE)}\\p{{M}}]*(?![A-Za-z])"
#: A letter that Latin has no double of proves that the words are of that script by nature.
_PROOF = f"[{_OTHER}&&[^{_SIGNS}{''.join(LOOK_ALIKES)}]]"
# Stretches of a value in this order: words of another script, plain text, a character with marks, a single suspicious character.
STRETCHES = f"(?s)({_WORDS}|[^{_ODD}{_OTHER}\\p{{M}}]+(?!{_UNSEEN}*\\p{{M}})|{_MARKED}|.)"
_PARTS = f"(?s)([^\\p{{M}}{_ODD}]+(?!{_UNSEEN}*\\p{{M}})|{_MARKED}|.)"


def _identity(value) -> list[Column]:
    """128 bits that stand for a value, so that no long value is a key."""
    return [F.xxhash64(value).alias("v1"), F.xxhash64(F.lit(7919), value).alias("v2")]


def _all(text, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _forms(values: DataFrame) -> DataFrame:
    """(v1, v2, n, value, form) of the distinct suspicious values of a column ``value`` whose form differs; n is how often they stand.

    The work is linear in the length: a value is cut into stretches in one pass, only suspicious ones are exploded to characters,
    and marks are folded within their own cluster. One shuffle by the value's identity serves all steps.
    """
    spark: SparkSession = values.sparkSession
    # Each table has a few thousand rows, whatever the data: it comes from the Unicode database.
    maps = F.broadcast(spark.createDataFrame(mapping_table(), "ch string, to string, kind string"))
    marks = F.broadcast(spark.createDataFrame(mark_table(), "c string, ccc int, bases string, composed string"))
    distinct = values.select("value", *_identity(F.col("value"))).groupBy("v1", "v2").agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("n"))

    def cut_up(x) -> Column:
        genuine = x.rlike(f"^{_LETTER}") & x.rlike(_PROOF)
        parts = F.when(x.rlike(f"^{_LETTER}"), _all(x, _PARTS)).otherwise(F.array(x))
        return F.transform(parts, lambda p: F.struct(genuine.alias("genuine"), p.alias("p")))

    stretches = distinct.select("v1", "v2", F.posexplode(F.flatten(F.transform(_all(F.col("value"), STRETCHES), cut_up))).alias("seg", "x"))
    open_ = F.when(F.col("x.genuine"), F.col("x.p").rlike(f"[{_ODD}\\p{{M}}]")).otherwise(F.col("x.p").rlike(SUSPICIOUS))
    chars = stretches.select("v1", "v2", "seg", "x.genuine", F.posexplode(F.when(open_, F.split("x.p", "")).otherwise(F.array("x.p"))).alias("pos", "ch"))
    mapped = chars.join(maps, "ch", "left").withColumn("known", F.col("kind").isNotNull() & ~(F.col("genuine") & (F.col("kind") == "look")))
    single = mapped.select("v1", "v2", "seg", "pos", F.posexplode(F.when(F.col("known") & (F.char_length("to") > 1), F.split("to", "")).otherwise(F.array(F.when(F.col("known"), F.col("to")).otherwise(F.col("ch"))))).alias("sub", "c")).join(marks, "c", "left")
    cluster = F.array_sort(F.collect_list(F.struct("pos", "sub", "c", F.coalesce("ccc", F.lit(0)).alias("ccc"), "bases", "composed")))
    ordered = single.groupBy("v1", "v2", "seg").agg(cluster.alias("cs")).withColumn("cs", F.filter("cs", lambda x: x["c"] != ""))  # what an invisible character leaves
    built = ordered.select("v1", "v2", "seg", F.when(F.exists("cs", lambda x: x["ccc"] > 0), _recomposed("cs")).otherwise(F.concat_ws("", F.transform("cs", lambda x: x["c"]))).alias("s"))
    whole = built.groupBy("v1", "v2").agg(F.array_sort(F.collect_list(F.struct("seg", "s"))).alias("ss")).select("v1", "v2", F.concat_ws("", F.transform("ss", lambda x: x["s"])).alias("form"))
    return distinct.join(whole, ["v1", "v2"]).where("form <> value")


def _recomposed(column: str) -> Column:
    """A cluster with its marks ordered by class behind their starter and composed with it where a composition exists."""
    none = "cast(array() as array<struct<ccc:int,n:int,c:string,bases:string,composed:string>>)"

    def step(acc, x):
        mark = F.struct(x["ccc"].alias("ccc"), F.size(acc["marks"]).alias("n"), x["c"].alias("c"), x["bases"].alias("bases"), x["composed"].alias("composed"))
        grown = F.struct(acc["done"].alias("done"), acc["starter"].alias("starter"), F.array_append(acc["marks"], mark).alias("marks"))
        following = F.struct(F.concat(acc["done"], _composed(acc)).alias("done"), x["c"].alias("starter"), F.expr(none).alias("marks"))
        return F.when(x["ccc"] > 0, grown).otherwise(following)

    return F.aggregate(column, F.struct(F.lit("").alias("done"), F.lit("").alias("starter"), F.expr(none).alias("marks")), step, lambda acc: F.concat(acc["done"], _composed(acc)))


def _composed(acc):
    """The starter with its sorted marks: each mark is composed if a composition exists and no mark of its class stayed."""

    def step(a, m):
        at = F.when(F.char_length(a["s"]) == 1, F.position(a["s"], m["bases"]))
        return F.when(
            (a["last"] < m["ccc"]) & (F.coalesce(at, F.lit(0)) > 0),
            F.struct(F.substring(m["composed"], at, F.lit(1)).alias("s"), a["rest"].alias("rest"), a["last"].alias("last")),
        ).otherwise(F.struct(a["s"].alias("s"), F.concat(a["rest"], m["c"]).alias("rest"), m["ccc"].alias("last")))

    return F.aggregate(F.array_sort(acc["marks"]), F.struct(acc["starter"].alias("s"), F.lit("").alias("rest"), F.lit(0).alias("last")), step, lambda a: F.concat(a["s"], a["rest"]))


def consistent_values(values: DataFrame, column: str) -> DataFrame:
    """``(value, form)`` of each distinct value of the column whose consistent form differs from it.

    Suspicious stretches of the value are exploded to positioned characters; a broadcast join gives decompositions, plain forms of
    full-width letters, digits, slashes and hyphens and of mathematical and circled letters, unified ideographs for radicals and compatibility forms, plain
    spaces, and nothing for invisible characters. Combining marks are ordered by class behind their letter
    and recomposed. Letters of other scripts drawn like Latin ones are replaced unless the words in another script that
    stand together (as in ГОСТ Р) hold a letter that Latin has no double of, as such words are of that script
    by nature. The signs μ and Ω, composed letters, Chinese punctuation and line ends stay.

    Nulls and empty values have no row, and neither have values that are consistent already. Repeated values come
    out once. Very long values are handled as any other.
    """
    return _forms(values.select(F.col(column).alias("value")).where(suspicious(F.col("value")))).select("value", "form")


def _with_forms(rows: DataFrame, value: str) -> DataFrame:
    """Rows with suspicious values and the ``form`` of each, null if it doesn't change; a value of very many rows is salted by a hash of the row."""
    forms = cut(_forms(rows.select(F.col(value).alias("value"))).select("v1", "v2", "n", "form"))
    salts = F.ceil(F.col("n") / HOT_ROWS).cast("int")
    # One row at most for every HOT_ROWS rows of input.
    hot = F.broadcast(forms.where(F.col("n") > HOT_ROWS).select("v1", "v2", salts.alias("salts")))
    hashable = [F.to_json(F.col(f"`{c}`")) if t.startswith(("map", "variant")) else F.col(f"`{c}`") for c, t in rows.dtypes]
    keyed = rows.select("*", *_identity(F.col(value))).join(hot, ["v1", "v2"], "left").withColumn("salt", F.pmod(F.xxhash64(*hashable), F.coalesce("salts", F.lit(1))).cast("int"))
    spread_forms = forms.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("v1", "v2", "salt", "form")
    return keyed.join(spread_forms, ["v1", "v2", "salt"], "left").select(*rows.columns, "form")


def with_consistent(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each of the columns in its consistent form; nulls stay null.

    Only rows with suspicious values are joined with the forms of the distinct ones; all others pass by, however many share a value.
    """
    names = df.columns
    df = df.toDF(*[f"c{i}" for i in range(len(names))])
    for column in columns:
        mine = f"c{names.index(column)}"
        odd = F.coalesce(suspicious(F.col(mine)), F.lit(False))
        changed = _with_forms(cut(df.where(odd)), mine).withColumn(mine, F.coalesce("form", mine)).drop("form")
        df = df.where(~odd).unionByName(changed)
    return df.toDF(*names)


def changed_values(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """(row_id, field_name, value, form) of every row and column whose value isn't in its consistent form."""
    long = df.select(F.col(row_id).alias("i"), F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in columns])).alias("x")).select("i", "x.field_name", "x.value").where(suspicious(F.col("value")))
    return _with_forms(cut(long), "value").where("form is not null").select(F.col("i").alias(row_id), "field_name", "value", "form")
