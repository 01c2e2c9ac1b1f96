"""Queries of the text problems, by name, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.llm import confusable
from docmill.llm.canonical import map_to_standards
from docmill.llm.chunk import split_oversized
from docmill.llm.confusable import changed_values
from docmill.llm.leak import leaked_items
from docmill.llm.mixing import mix_sources, mixture_shares, token_counts
from docmill.llm.pii import pii_spans, redacted
from docmill.llm.repetition import FRAME, repetition
from docmill.llm.scan_noise import repair_scans
from docmill.session import cut, read, spread

# Full-width digits and letters and their narrow forms.
_WIDE, _NARROW = "".join(chr(c) for a, z in ("09", "AZ", "az") for c in range(ord(a) + 0xFEE0, ord(z) + 0xFEE1)), "".join(chr(c) for a, z in ("09", "AZ", "az") for c in range(ord(a), ord(z) + 1))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Language, perplexities, band and share of repeated content of every preview."""
    return repetition(read(spark, d, "recovery_audit"), "audit_id", "raw_response_preview", FRAME).select("audit_id", "lang", "n_chars", "band", "repeated_share")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Entries that a perplexity band of their language rejects and that are mostly repeated text by the exact share."""
    measured = repetition(read(spark, d, "recovery_audit"), "audit_id", "raw_response_preview", FRAME)
    return measured.where("band in ('low', 'high') and repeated_share > 0.5").select("audit_id").distinct()


def p1_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Entries that the lower or the upper band of their language rejects."""
    return repetition(read(spark, d, "recovery_audit"), "audit_id", "raw_response_preview", FRAME).where("band in ('low', 'high')").select("audit_id", "lang", "band")


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    typed = read(spark, d, "stage2_result").where("type = 'TYPE_B'").select("result_id", "entity")
    return map_to_standards(typed, "entity", read(spark, d, "gb_dict"), "基础编号", "标准名称")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary code that each Chinese standard means, or NONE."""
    return _mapped(spark, d).select("result_id", F.coalesce("matched_code", F.lit("NONE")).alias("base_code")).distinct()


def p2_misses(spark: SparkSession, d: str) -> DataFrame:
    """The values without a match, why, and how many rows have them."""
    return _mapped(spark, d).where("matched_code is null").groupBy("entity", F.col("matched_by").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    return repair_scans(read(spark, d, "text_units"), "text_unit_id", "text", "chapter_title", "company_name", "source_file")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """What noise of scanned pages was found where."""
    return _repaired(spark, d).select("text_unit_id", "field_name", F.explode("kinds").alias("noise_kind")).distinct()


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The repaired texts and titles."""
    return _repaired(spark, d).select("text_unit_id", "field_name", "repaired")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every text unit as pieces of at most 1,200 characters, numbered in place of unit_order."""
    units = read(spark, d, "text_units").groupBy("text_unit_id").agg(F.max(F.struct("loaded_at", "text")).alias("u")).select("text_unit_id", F.col("u.text").alias("text"))
    return split_oversized(units, "text").select("text_unit_id", F.col("piece_no").alias("unit_order"), F.col("piece").alias("text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Units that come out as several pieces."""
    return split_oversized(read(spark, d, "text_units").select("text_unit_id", "text"), "text").where("pieces > 1").select("text_unit_id").distinct()


def p5_whole(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pieces of a unit are within the limit, begin with the end of the one before, and give the text when put together."""
    pieces = p5_pieces(spark, d).where("text is not null")
    rest = F.when(F.col("unit_order") == 1, F.col("text")).otherwise(F.substring("text", F.lit(101), F.char_length("text")))
    order = W.partitionBy("text_unit_id").orderBy("unit_order")
    overlaps = (F.col("unit_order") == 1) | (F.left("text", F.lit(100)) == F.right(F.lag("text").over(order), F.lit(100)))
    joined = pieces.withColumn("overlaps", overlaps).withColumn("rest", rest).groupBy("text_unit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_order", "rest"))), lambda x: x["rest"]), "").alias("whole"), F.max(F.char_length("text")).alias("longest"), F.every("overlaps").alias("overlaps"))
    units = read(spark, d, "text_units").groupBy("text_unit_id").agg(F.max(F.struct("loaded_at", "text")).alias("u")).where("u.text is not null").select("text_unit_id", "u.text")
    return units.join(joined, "text_unit_id", "left").select("text_unit_id", (F.col("whole") == F.col("text")).alias("rebuilt"), (F.col("longest") <= 1200).alias("within"), "overlaps")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Values of entity and evidence that aren't in their consistent form."""
    return changed_values(read(spark, d, "stage2_result"), "result_id", ["entity", "evidence"]).select("result_id", "field_name").distinct()


def p7_values(spark: SparkSession, d: str) -> DataFrame:
    """The changed values with their consistent form."""
    return changed_values(read(spark, d, "stage2_result"), "result_id", ["entity", "evidence"])


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(read(spark, d, "documents"), "doc_id", "text", read(spark, d, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with 50 or more consecutive letters or digits of an evaluation item."""
    return _leaks(spark, d).where("verbatim_run >= 50").select("doc_id", "item_id").distinct()


def p8_reworded(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an item's wording with other figures, units or organisations."""
    return _leaks(spark, d).where("reworded").drop("verbatim_run", "reworded")


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    sizes = spread(read(spark, d, "documents").select("doc_id", "source", "text"), "doc_id").select("doc_id", "source", token_counts(F.col("text")).alias("n_tokens"))
    return mix_sources(sizes, "doc_id", "source", "n_tokens", read(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture with the number of times each is used."""
    return _mixture(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source in the mixture."""
    return mixture_shares(_mixture(spark, d), "source", "n_tokens", read(spark, d, "mix_targets"))


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source misses its share by less than the size of two documents and no document is used too often."""
    targets, mixture = read(spark, d, "mix_targets"), cut(_mixture(spark, d))
    shares = mixture_shares(mixture, "source", "n_tokens", targets)
    whole = mixture.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("total"), F.max("n_tokens").alias("largest"))
    on_target = F.abs(F.col("used") - F.col("target_share") * F.col("total")) <= 2 * F.col("largest")
    return shares.crossJoin(whole).select("source", on_target.alias("on_target"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"))  # one row


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Names, e-mail addresses, telephone numbers, identity numbers and street addresses as they stand in the text."""
    found = pii_spans(read(spark, d, "documents"), "doc_id", "text")
    return found.select("doc_id", F.col("kind").alias("pii_kind"), F.col("value").alias("pii_value")).distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The documents with typed placeholders in place of personal values."""
    documents = read(spark, d, "documents")
    return redacted(documents, "doc_id", "text", pii_spans(documents, "doc_id", "text")).select("doc_id", "text")


def p10_undone(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document's placeholders, filled again with the values found, give its text."""
    documents = read(spark, d, "documents").where("doc_id is not null and text is not null")
    spans = pii_spans(documents, "doc_id", "text")
    values = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "value"))).alias("s"))
    both = redacted(documents, "doc_id", "text", spans).select("doc_id", F.col("text").alias("clean")).join(documents.select("doc_id", "text"), "doc_id").join(values, "doc_id", "left")
    until = lambda a, m: F.call_function("substring_index", a, m, F.lit(1))
    mark = lambda x: F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))
    # Values are put back from the left: what precedes a placeholder is done already.
    first = F.struct(F.lit("").alias("done"), F.col("clean").alias("rest"))
    filled = F.aggregate("s", first, lambda a, x: F.struct(F.concat(a["done"], until(a["rest"], mark(x)), x["value"]).alias("done"), F.substring(a["rest"], F.char_length(until(a["rest"], mark(x))) + F.char_length(mark(x)) + 1, F.char_length(a["rest"])).alias("rest")))
    whole = F.when(F.col("s").isNull(), F.col("clean")).otherwise(F.concat(filled["done"], filled["rest"]))
    return both.select("doc_id", (whole == F.col("text")).alias("undone"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_shares, p1_rejected, p2_found, p2_misses, p4_found, p4_repaired, p5_found, p5_pieces, p5_whole, p7_found, p7_values, p8_found, p8_reworded, p9_mix, p9_shares, p9_limits, p10_found, p10_redacted, p10_undone)}


def _range(chars) -> str:
    codes = sorted(set(map(ord, chars)))
    starts = [c for c, before in zip(codes, [-1, *codes]) if c != before + 1]
    stops = [c for c, after in zip(codes, [*codes[1:], -1]) if after != c + 1]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, stops))


def oracle_sql() -> dict[str, str]:
    odd = _range([c for c, _, kind in confusable.mapping_table() if kind in ("space", "invisible", "hyphen", "wide", "ideograph") or kind == "look" and c not in confusable.LOOK_ALIKES])
    # Words of another script that hold a letter without a Latin double are taken out before look-alikes are sought.
    twins = _range(confusable.LOOK_ALIKES)
    own = _range(chr(c) for lo, hi in ((0x370, 0x3FF), (0x400, 0x52F), (0x531, 0x587), (0x13A0, 0x13F5), (0xA4D0, 0xA4FD)) for c in range(lo, hi + 1) if chr(c) not in confusable.LOOK_ALIKES and chr(c) not in confusable._SIGNS)
    alien = f"nfc_normalize(value) <> value or regexp_matches(value, '[{odd}]') or regexp_matches(regexp_replace(value, '[{twins}{own} ]*[{own}][{twins}{own} ]*', ' ', 'g'), '[{twins}]')"
    single = [(c, to, kind) for c, to, kind in confusable.mapping_table() if kind in ("space", "hyphen", "wide", "ideograph", "look") and len(to) == 1]
    quoted = lambda x: x.replace("'", "''")
    gone = "".join(confusable.INVISIBLE)
    # Characters to drop come last, where nothing stands for them.
    plain = lambda kinds: f"nfc_normalize(translate(value, '{quoted(''.join(c for c, _, k in single if k in kinds) + gone)}', '{quoted(''.join(to for _, to, k in single if k in kinds))}'))"
    genuine = f"regexp_matches(value, '[{twins}{own} ]*[{own}][{twins}{own} ]*')"
    form = f"case when {genuine} then {plain(('space', 'hyphen', 'wide', 'ideograph'))} else {plain(('space', 'hyphen', 'wide', 'ideograph', 'look'))} end"
    values = "v as (select result_id, 'entity' as field_name, entity as value from stage2_result union all select result_id, 'evidence', evidence from stage2_result)"
    letters = lambda x: f"regexp_replace(lower(translate({x}, '{_WIDE}', '{_NARROW}')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    runs = lambda t, i, x: f"select {i} as id, unnest(range(1, length(f) - 48)) as at, f from (select {i}, {letters(x)} as f from {t} where {x} is not null)"
    return {
        "p5_found": "select distinct text_unit_id from text_units where length(text) > 1200",
        "p5_whole": "select text_unit_id, true as rebuilt, true as within, true as overlaps from text_units group by text_unit_id having max_by(text, loaded_at) is not null",
        "p7_found": f"with {values} select distinct result_id, field_name from v where {alien}",
        "p7_values": f"with {values}, f as (select *, {form} as form from v) select result_id, field_name, value, form from f where form <> value",
        "p8_found": f"with d as ({runs('documents', 'doc_id', 'text')}), i as ({runs('eval_items', 'item_id', 'text')}) select distinct d.id as doc_id, i.id as item_id from d join i on substr(d.f, d.at, 50) = substr(i.f, i.at, 50)",
        "p9_limits": "select source, true as on_target, true as within_repeats from mix_targets",
        "p10_undone": "select doc_id, true as undone from documents where text is not null",
    }
