"""Queries of the analytics operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import lines as L
from docmill.functions import norm as N
from docmill.functions.anchors import ANCHOR_TERMS
from docmill.operators import cleaner, extraction, indicators, keywords, lineblocks, mapping, provider, replies, review, screening
from docmill.operators.asof import asof_valid
from docmill.session import cut, read

#: A small dictionary for the queries; real runs read theirs from a file.
TERMS = ["ISO", "IEC", "GB/T", "CE", "质量管理体系", "认证证书", "Quality Management System", "合规审查", "Accreditation"]


def _units(spark: SparkSession, d: str) -> DataFrame:
    """One row a unit: units that were loaded twice count once."""
    return screening.last_by_id(read(spark, d, "text_units").where("text_unit_id is not null").select(*screening.UNIT_COLUMNS, "loaded_at"), "text_unit_id", "loaded_at", "year").drop("loaded_at")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lineblocks.lines_of(read(spark, d, "text_units").select("text_unit_id", "text").distinct(), ["text_unit_id"], "text")


def unit_lines(spark, d):
    """Lines of every unit, in order."""
    return _lines(spark, d)


def stock_codes(spark, d):
    return read(spark, d, "stage2_result").select("stock_code").distinct().select("stock_code", N.stock_code(F.col("stock_code")).alias("code"))


def standard_codes(spark, d):
    p = N.standard_code(F.col("entity"))
    e = read(spark, d, "stage2_result").where("type = 'TYPE_B'").select("entity").distinct()
    return e.select("entity", p["base"].alias("base"), p["version"].alias("version"), N.full_year(p["version"]).alias("version_year"))


def report_years(spark, d):
    return read(spark, d, "text_units").select("year").distinct().select("year", N.report_year(F.col("year")).alias("y"))


def tolerant_bools(spark, d):
    forms = F.element_at(F.array(*map(F.lit, ("TRUE", " yes ", "1", "no", "Y", "0", "", "maybe"))), (F.col("audit_id") % 8 + 1).cast("int"))
    return read(spark, d, "recovery_audit").select("audit_id", N.tolerant_bool(F.when(F.col("parse_success"), forms)).alias("flag"))


def line_flags(spark, d):
    x = F.col("line")
    return _lines(spark, d).select("text_unit_id", "ln", L.is_dot_leader(x).alias("contents"), L.is_page_number(x).alias("page"), L.is_report_header(x).alias("report"), L.is_company_header(x).alias("company"), L.is_short_line(x).alias("short"), L.is_strong_noise(x).alias("strong"), L.is_probable_title(x).alias("title"))


def line_scores(spark, d):
    return _lines(spark, d).select("text_unit_id", "ln", L.table_score(F.col("line")).alias("score"))


def noise_scores(spark, d):
    return lineblocks.noise_scores(read(spark, d, "text_units").select("text_unit_id", "text").distinct(), ["text_unit_id"], "text")


def dropped_lines(spark, d):
    return lineblocks.droppable_lines(_lines(spark, d), ["text_unit_id"]).select("text_unit_id", "ln", "is_header", "near_header", "dropped")


def table_blocks(spark, d):
    b = lineblocks.table_blocks(_lines(spark, d), ["text_unit_id"])
    return b.withColumn("mean_score", F.round("mean_score", 6))


def anchored_lines(spark, d):
    return lineblocks.anchored_context(_lines(spark, d), ["text_unit_id"], ["ISO", "认证", "CE"]).select("text_unit_id", "ln", "anchored", "protected")


def keyword_flags(spark, d):
    return _units(spark, d).select("text_unit_id", L.has_term(F.col("text"), TERMS).alias("keyword_candidate"))


def keyword_terms(spark, d):
    return keywords.keyword_features(_units(spark, d), TERMS).withColumn("matched_terms", F.array_join("matched_terms", ";"))


def anchor_flags(spark, d):
    return read(spark, d, "documents").select("doc_id", L.has_term(F.col("text"), ANCHOR_TERMS).alias("anchored"))


def fixed_slices(spark, d):
    """Slices of 300 characters, stripped, without empty ones."""
    n = F.ceil(F.char_length("text") / 300).cast("int")
    piece = F.transform(F.sequence(F.lit(0), n - 1), lambda i: N.strip(F.col("text").substr(i * 300 + 1, F.lit(300))))
    rows = read(spark, d, "documents").where("char_length(text) > 0").select("doc_id", F.posexplode(piece).alias("slice_no", "piece"))
    return rows.where("piece <> ''")


def packed_units(spark, d):
    """Documents as units of 500 to 1200 characters."""
    docs = read(spark, d, "documents").select("doc_id", cleaner.chunk_text(F.col("text")).alias("u"))
    return docs.select("doc_id", F.posexplode("u").alias("unit_no", "unit"))


def packed_units_whole(spark, d):
    """Whether a document's units hold all of its text but white space, none is empty, and none is over what a unit may grow to."""
    settings = cleaner.UnitSettings()
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("*", cleaner.chunk_text(F.col("text"), settings).alias("u"))
    whole = N.compact(F.array_join("u", "")) == N.compact(N.nfkc(F.col("text")))
    return docs.select("doc_id", whole.alias("whole"), F.forall("u", lambda x: F.char_length(x).between(1, settings.overflow)).alias("in_bounds"))


def report_units_numbered(spark, d):
    """Whether the units of a report are numbered from 1 without a gap, under ids of their own."""
    u = report_units(spark, d)
    per = u.groupBy(F.col("source_file").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.min("unit_order").alias("first"), F.max("unit_order").alias("last"), F.count_distinct("text_unit_id").alias("ids"), F.min(F.char_length("text")).alias("least"))
    docs = read(spark, d, "documents").select("doc_id").distinct().join(per, "doc_id", "left")
    return docs.select("doc_id", F.coalesce((F.col("first") == 1) & (F.col("last") == F.col("n")) & (F.col("ids") == F.col("n")) & (F.col("least") > 0), F.lit(True)).alias("numbered"))


def report_units(spark, d):
    """All documents as reports: chapters, cleaning and text units; those without a stock_code have ids that begin with NA."""
    reports = read(spark, d, "documents").select("stock_code", F.col("source").alias("company_name"), F.year("published_at").cast("string").alias("year"), F.col("doc_id").cast("string").alias("source_file"), "text")
    return cleaner.text_units(reports)


def noise_audit(spark, d):
    """A dry run of the clean-up."""
    return cleaner.noise_audit(_units(spark, d))


def noise_audit_lengths(spark, d):
    """Scores, lengths and previews of the dry run, and whether the clean-up only removes."""
    a = cleaner.noise_audit(_units(spark, d))
    return a.select("text_unit_id", "table_noise_score", "raw_text_len", "raw_preview", (F.col("filtered_text_len") <= F.col("raw_text_len") + 1).alias("shorter"), F.col("removed_ratio").between(0, 1).alias("in_range"))


def screening_normalised(spark, d):
    raw = F.to_json(F.struct("relevance", "confidence_score", "reason"))
    r = replies.screening_reply(raw)
    return read(spark, d, "stage1_relevance").distinct().select("text_unit_id", "reason", r["relevance"].alias("relevance"), r["confidence_score"].alias("score"), r["status"].alias("status"))


def screening_rescued(spark, d):
    raw = F.concat(F.lit('{"relevance": "'), F.coalesce("relevance", F.lit("")), F.lit('", "confidence_score": '), F.coalesce(F.col("confidence_score").cast("string"), F.lit("0")), F.lit(', "reason": "said "'), F.coalesce("reason", F.lit("")), F.lit('" here"}'))
    r = replies.screening_reply(raw)
    return read(spark, d, "stage1_relevance").distinct().select("text_unit_id", r["relevance"].alias("relevance"), F.round(r["confidence_score"], 6).alias("score"), r["reason"].alias("said"), r["status"].alias("status"))


def screening_once(spark, d):
    return screening.one_screening(read(spark, d, "stage1_relevance"))


def _stub(_: str, user: str) -> str:
    kind = "related" if "证书" in user else "uncertain" if "培训" in user else "unrelated"
    return f'{{"relevance": "{kind}", "confidence_score": 0.5, "reason": "stub"}}'


def screening_resumed(spark, d):
    """Units that an earlier screening holds, that a keyword decides, and that a stub model is asked about."""
    u = _units(spark, d)
    features = u.select("text_unit_id", F.contains("text", F.lit("认证证书")).alias("keyword_candidate"))
    done = read(spark, d, "stage1_relevance").where("stage1_status = 'OK' and confidence_score >= 0.7")
    out = screening.screen_units(u, "", provider.StubProvider(_stub), features, done)
    return out.select("text_unit_id", F.when(F.col("reason") == "stub", "asked").when(F.col("stage1_status") == "OK", "kept").otherwise(F.col("stage1_status")).alias("how"), F.when(F.col("reason") == "stub", F.col("relevance")).alias("asked_relevance"))


def _features(spark, d):
    return _units(spark, d).select("text_unit_id", L.has_term(F.col("text"), TERMS).alias("keyword_candidate"), F.lit("").alias("matched_terms"))


def _routed(spark, d):
    return screening.route_units(_units(spark, d), _features(spark, d), read(spark, d, "stage1_relevance"))


def routed_units(spark, d):
    return _routed(spark, d).select("text_unit_id", "keyword_candidate", "relevance", "confidence_score", "route_reason")


def _variant(method):
    def query(spark, d):
        return screening.variant_units(method, _units(spark, d), _features(spark, d), read(spark, d, "stage1_relevance")).select("text_unit_id", "chapter_title")

    return query


def reply_items(spark, d):
    """Items of the first object in every audited reply."""
    r = read(spark, d, "recovery_audit").select("audit_id", replies.lenient_reply(F.col("raw_response_preview")).alias("items"))
    return replies.entity_rows(r, "items")


def reply_outcomes(spark, d):
    """How every audited reply can be read: strictly, after repair or not at all, with its errors."""
    r = read(spark, d, "recovery_audit").select("audit_id", replies.strict_reply(F.col("raw_response_preview")).alias("r"))
    return r.select("audit_id", "r.method", F.coalesce(F.size("r.items"), F.lit(-1)).alias("n_items"), F.array_join("r.errors", "; ").alias("errors"), F.array_join("r.actions", ",").alias("actions"))


def reply_strict(spark, d):
    """Whether every audited reply is one whole object by the rules, and how many items it has."""
    r = read(spark, d, "recovery_audit").select("audit_id", replies.strict_reply(F.col("raw_response_preview")).alias("r"))
    return r.select("audit_id", (F.col("r.method") == "strict").alias("strict"), F.when(F.col("r.method") == "strict", F.size("r.items")).alias("n_items"))


def reply_char_repeats(spark, d):
    """Whether one ideograph stands 30 times in a row in a reply."""
    flags = replies.degeneration_flags(F.col("raw_response_preview"))
    return read(spark, d, "recovery_audit").select("audit_id", F.array_contains(flags, "single_char_repeat").alias("repeats"))


def reply_degeneration(spark, d):
    return read(spark, d, "recovery_audit").select("audit_id", F.array_join(replies.degeneration_flags(F.col("raw_response_preview")), ",").alias("flags"))


def reply_audit(spark, d):
    r = F.coalesce("text", F.lit(""))
    return read(spark, d, "documents").select("doc_id", F.sha2(r, 256).alias("sha256"), F.char_length(r).alias("n"), N.head_and_tail(F.col("text"), 200, 100).alias("preview"), N.truncated(F.col("text"), 400).alias("cut"))


def grounded_results(spark, d):
    r = read(spark, d, "stage2_result").join(_units(spark, d).select("text_unit_id", "text"), "text_unit_id")
    return replies.grounding(r, "entity", "evidence", "text").select("result_id", "entity_grounded", "evidence_grounded")


def failure_rows(spark, d):
    return read(spark, d, "stage2_result").where(extraction.is_failure()).select("result_id", "text_unit_id")


def extraction_status(spark, d):
    queue = read(spark, d, "recovery_audit").where("final_disposition = 'failed'").select("text_unit_id")
    return extraction.stage2_status(read(spark, d, "stage2_result"), queue, _units(spark, d))


def pending_units(spark, d):
    return extraction.pending_units(_units(spark, d), read(spark, d, "stage2_result")).select("text_unit_id")


def seeded_results(spark, d):
    targets = _routed(spark, d)
    rows, _ = extraction.seed_results(targets, read(spark, d, "stage2_result"), read(spark, d, "stage2_result").where("status = 'PENDING'"))
    return rows.select("result_id", "text_unit_id")


def seeded_missing(spark, d):
    return extraction.seed_results(_units(spark, d), read(spark, d, "stage2_result"))[1]


def _mapped(spark, d):
    return mapping.mapped_entities(extraction.successful_rows(read(spark, d, "stage2_result")), read(spark, d, "gb_dict"))


def mapped_entities(spark, d):
    return _mapped(spark, d).select("result_id", F.col("国际标准").alias("standard"), F.col("采标情况").alias("adoption"), "output")


def firm_years(spark, d):
    return indicators.firm_years(read(spark, d, "text_units"), _mapped(spark, d))


def _finals(spark, d):
    """The four methods over units, features and entities that are made once."""
    slim = cut(_units(spark, d).select("text_unit_id", "stock_code", "company_name", "year", L.has_term(F.col("text"), TERMS).alias("keyword_candidate")))
    units, features = slim.drop("keyword_candidate"), slim.select("text_unit_id", "keyword_candidate", F.lit("").alias("matched_terms"))
    mapped, screened = cut(_mapped(spark, d).select("text_unit_id", "stock_code", "year", "entity", "status", "output")), read(spark, d, "stage1_relevance")
    out = {}
    for m in indicators.METHODS:
        u = screening.route_units(units, features, screened) if m == "main" else screening.variant_units(m, units, features, screened)
        out[m] = indicators.firm_years(u, mapped.join(u.select("text_unit_id"), "text_unit_id", "left_semi"))
    return out


def compared_methods(spark, d):
    return indicators.consistency(indicators.collected(_finals(spark, d)))


def run_counts(spark, d):
    final = indicators.firm_years(read(spark, d, "text_units"), _mapped(spark, d))
    queue = read(spark, d, "recovery_audit").where("final_disposition = 'failed'").select("text_unit_id")
    slim = cut(_units(spark, d).select("text_unit_id", L.has_term(F.col("text"), TERMS).alias("keyword_candidate")))
    features, screened = slim.withColumn("matched_terms", F.lit("")), read(spark, d, "stage1_relevance")
    return indicators.manifest(slim, features, screened, screening.route_units(slim.select("text_unit_id"), features, screened), read(spark, d, "stage2_result"), queue, final)


def sampled_units(spark, d):
    return review.sample_per_group(_units(spark, d).where("stock_code is not null"), "stock_code", "text_unit_id", 3).select("stock_code", "text_unit_id")


def text_lengths(spark, d):
    return review.length_summary(read(spark, d, "text_units"), "text")


def reviewed_results(spark, d):
    r = read(spark, d, "stage2_result").select(*extraction.RESULT_COLUMNS)
    bad = r.where(extraction.is_failure()).select("text_unit_id", F.lit("ISO 9001").alias("entity"), F.lit("TYPE_A").alias("type"), F.lit("ADOPTED").alias("status"), F.lit("reviewed").alias("evidence")).distinct()
    out = review.apply_review(r, bad)
    return out.groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text_unit_id").alias("units"))


def recovery_check(spark, d):
    return review.recovery_report(read(spark, d, "stage2_result"), read(spark, d, "stage2_result_copy"))


def duplicate_contents(spark, d):
    return review.duplicate_rows(read(spark, d, "stage2_result"))


def event_asof(spark, d):
    """The latest event of another type that each purchase's user had by then."""
    e = read(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return asof_valid(e.where("event_type = 'purchase'").withColumnRenamed("event_id", "purchase_id"), e.where("event_type = 'view'").withColumnRenamed("event_id", "view_id"), "user_id", "purchase_id", "at", "view_id", "at")


_QUERIES = (
    unit_lines, stock_codes, standard_codes, report_years, tolerant_bools, line_flags, line_scores, noise_scores, dropped_lines, table_blocks, anchored_lines, keyword_flags, keyword_terms, anchor_flags, fixed_slices, packed_units, packed_units_whole, report_units, report_units_numbered, noise_audit, noise_audit_lengths,
    screening_normalised, screening_rescued, screening_once, screening_resumed, routed_units, reply_items, reply_outcomes, reply_degeneration, reply_strict, reply_char_repeats, reply_audit, grounded_results, failure_rows, extraction_status, pending_units, seeded_results, seeded_missing,
    mapped_entities, firm_years, compared_methods, run_counts, sampled_units, text_lengths, reviewed_results, recovery_check, duplicate_contents, event_asof,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES} | {f"variant_{m}": _variant(m) for m in ("keyword", "llm_only", "full_llm")}


def oracle_sql() -> dict[str, str]:
    from docmill.plans.reference_sql import statements

    return statements(TERMS)
