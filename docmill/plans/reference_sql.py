"""SQL (DuckDB) of the analytics queries."""

from __future__ import annotations

from docmill.functions.anchors import ANCHOR_TERMS
from docmill.functions.lines import CELL_LINE, COMPANY_LINE, DATE_LINE, FALSE_TITLE_HINTS, LEADERS, PURE_VALUE, QUOTED_TITLE, RATIO_LINE, SHORT_LINE, SHORT_NUMERIC, TITLE_LINE
from docmill.functions.norm import _ASCII, _WIDE, SPACE
from docmill.plans.core_found import _sql_date


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def statements(terms: list[str]) -> dict[str, str]:
    compact = lambda x: f"regexp_replace({x}, '[{SPACE}]+', '', 'g')"
    strip = lambda x: f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
    fold = lambda x: f"translate({x}, {_text(_WIDE)}, {_text(_ASCII)})"
    title = lambda x: f"regexp_replace({strip(f"regexp_replace({fold(x)}, '[{SPACE}]+', ' ', 'g')")}, '^[- ]+|[- ]+$', '', 'g')"
    n = lambda x: f"length({compact(x)})"
    has = lambda x, p: f"regexp_matches({x}, {_text(p)})"
    plain = lambda x: f"nullif(translate({strip(fold(x))}, '–—－（）', '---()'), '')"

    lines = "lines as (select text_unit_id, unnest(range(0, len(a))) as ln, unnest(a) as line from (select distinct text_unit_id, text, string_split(text, chr(10)) as a from text_units))"
    leader = lambda x: f"({has(title(x), LEADERS)} and {has(title(x), f'[0-9]{{1,4}}[{SPACE}]*$')})"
    strong = lambda x: f"({has(compact(x), '[0-9]')} and ({has(compact(x), '^[0-9]{1,4}$')} or {has(compact(x), DATE_LINE)} or {has(compact(x), PURE_VALUE)} or {has(compact(x), RATIO_LINE)}))"
    short = lambda x: f"({n(x)} > 0 and ({n(x)} <= {SHORT_LINE} or ({n(x)} <= {SHORT_NUMERIC} and {has(strip(x), r'^[0-9,.\-+%/()（）A-Za-z_]+$')})))"
    page = lambda x: has(strip(x), "^[0-9]{1,4}$")
    report = lambda x: f"(contains({compact(x)}, '年度报告') and {n(x)} <= {TITLE_LINE})"
    company = lambda x: f"({n(x)} <= {COMPANY_LINE} and suffix({compact(x)}, '有限公司'))"
    probable = lambda x: f"({n(title(x))} between 1 and {TITLE_LINE} and not {leader(x)} and not {has(title(x), '[。；;，,：:之]')} and not {has(title(x), '|'.join(FALSE_TITLE_HINTS))} and not {has(title(x), QUOTED_TITLE)})"
    ratio = lambda x: f"(length(regexp_replace({compact(x)}, '[^0-9]', '', 'g')) / greatest({n(x)}, 1))"
    sentence = lambda x: has(strip(x), "[。！？!?；;]")
    score = lambda x: (
        f"cast(case when {strip(x)} = '' then 0 when {strong(x)} then 1 when {short(x)} then 0.8 when {n(x)} <= {CELL_LINE} and not {sentence(x)} then 0.6 when {ratio(x)} >= 0.5 and not {sentence(x)} then 0.9 "
        f"when len(regexp_extract_all({strip(x)}, '[-+]?[0-9][0-9,.]*(%|‰)?')) >= 2 and {ratio(x)} >= 0.25 and not {has(strip(x), '[。！？!?]')} then 0.65 else 0 end as double)"
    )
    scored = f"{lines}, scored as (select *, {score('line')} as score from lines)"

    ascii_ = [t for t in terms if t[0].isascii() and t[0].isalpha()]
    other = [t for t in terms if t not in ascii_]
    term = f"coalesce(regexp_matches(text, '(?i)(^|[^A-Za-z])({'|'.join(ascii_)})([^A-Za-z]|$)') or regexp_matches(text, '{'|'.join(other)}'), false)"
    bound = lambda c: c.isascii() and c.isalpha()
    pattern = "|".join(("(^|[^A-Za-z])" if bound(t[0]) else "") + t + ("([^A-Za-z]|$)" if bound(t[-1]) else "") for t in ANCHOR_TERMS)
    anchored = f"coalesce(regexp_matches(text, '(?i){pattern}'), false)"
    units = "u as (select * from text_units where text_unit_id is not null qualify row_number() over (partition by text_unit_id order by loaded_at desc nulls last, year desc nulls last) = 1)"
    once = "once as (select text_unit_id, lower(trim(relevance)) as relevance, confidence_score from stage1_relevance qualify row_number() over (partition by text_unit_id order by (stage1_status <> 'ERROR') desc, coalesce(confidence_score, -1) desc, lower(trim(relevance)) desc nulls last, confidence_score desc nulls last) = 1)"
    words = f"words as (select text_unit_id, {term} as keyword_candidate from u)"
    routed = f"{units}, {once}, {words}, routed as (select u.*, keyword_candidate, coalesce(relevance, '') as relevance, confidence_score, concat_ws('+', case when keyword_candidate then 'keyword' end, case when relevance in ('related', 'uncertain') then 'stage1_' || relevance end) as route_reason from u left join words using (text_unit_id) left join once using (text_unit_id) where keyword_candidate or relevance in ('related', 'uncertain'))"
    failure = "(coalesce(upper(trim(entity)) = 'ERROR', false) or coalesce(upper(trim(type)) = 'LLM_FAILURE', false) or coalesce(upper(trim(status)) = 'FAIL', false))"
    done = f"done as (select distinct text_unit_id from stage2_result where not {failure} and text_unit_id is not null)"
    bad = f"bad as (select distinct text_unit_id from (select text_unit_id from stage2_result where {failure} union all select text_unit_id from recovery_audit where final_disposition = 'failed') where text_unit_id <> '' and text_unit_id not in (select text_unit_id from done))"

    squeezed = lambda x: f"upper({strip(f"regexp_replace({plain(x)}, '[{SPACE}]+', ' ', 'g')")})"
    main, tail = r"^([A-Z]+(/[A-Z]+)?\s*[0-9]+(\.[0-9]+)*)([-:]([0-9]{2,4}))?$", r"^(.*)-([0-9]{2,4})$"
    bare = lambda x: f"regexp_replace({x}, '[ -]', '', 'g')"

    def base(x: str) -> str:
        s = squeezed(x)
        return f"case when {has(s, main)} then replace(regexp_extract({s}, '{main}', 1), ' ', '') when {has(s, tail)} then {bare(f"regexp_extract({s}, '{tail}', 1)")} else {bare(s)} end"

    def version(x: str) -> str:
        s = squeezed(x)
        return f"nullif(case when {has(s, main)} then regexp_extract({s}, '{main}', 5) when {has(s, tail)} then regexp_extract({s}, '{tail}', 2) end, '')"

    full = lambda v: f"case when length({v}) = 4 then cast({v} as int) when length({v}) = 2 then cast({v} as int) + case when cast({v} as int) > 50 then 1900 else 2000 end else 0 end"

    def year(x: str) -> str:
        s = plain(x)
        four = f"regexp_extract({s}, '(^|[^\\p{{L}}\\p{{N}}_])([0-9]{{4}})([^\\p{{L}}\\p{{N}}_]|$)', 2)"
        return f"case when {four} <> '' then cast({four} as int) when {has(s, '^[0-9]{2}$')} then {full(s)} end"

    strict = lambda x: f"case when not regexp_matches({x}, '[年月日]') and {_sql_date(x)} between date '1677-09-22' and date '2262-04-10' then {_sql_date(x)} end"
    option = lambda x: f"nullif({strip(x)}, '')"
    mapped = f"""
        v as (select base, version, code, international, adoption, effective, expiry, state, quality from (select {base('"标准号"')} as base, {full(version('"标准号"'))} as version, "标准号" as code, {option('"国际标准编号"')} as international, {option('"采标类型"')} as adoption,
            {strict('"生效日期"')} as effective, {strict('"失效日期"')} as expiry, {option('"当前状态"')} as state, {option('"时间数据质量"')} as quality from gb_dict) where base is not null),
        probe as (select distinct entity, year, {base('entity')} as base, {version('entity')} as asked, {year('year')} as y from stage2_result where type = 'TYPE_B' and not {failure}),
        best as (select probe.entity, probe.year, code, international, adoption, asked, (y is null or (version <= y and coalesce(effective <= make_date(y, 12, 31), true))) as in_time from probe join v using (base)
            where (asked is not null and version = {full('asked')}) or (asked is null and (y is null or (version > 0 and version <= y and not coalesce(contains(quality, 'LEGACY_ONLY_NO_TEMPORAL_METADATA'), false)
                and (effective is null or (effective <= make_date(y, 12, 31) and coalesce(expiry > make_date(y, 12, 31), true) and not (expiry is null and coalesce(state = '废止', false)))))))
            qualify row_number() over (partition by probe.entity, probe.year order by case when asked is null and y is null then null else coalesce(effective, case when version > 0 then make_date(version, 1, 1) end) end desc nulls last, version desc, code desc) = 1),
        m as (select r.*, b.international, b.adoption from (select * from stage2_result where not {failure}) r left join (select * from best where in_time or asked is null) b on r.type = 'TYPE_B' and r.entity = b.entity and r.year is not distinct from b.year),
        mapped as (select *, case when type = 'TYPE_B' then international else entity end as standard, case when type = 'TYPE_B' then case when international is not null then coalesce(adoption, '已找到采标信息') else '未找到采标信息' end else type end as adopted_as,
            case when type = 'TYPE_B' then international is not null and coalesce(status = 'ADOPTED', false) when type in ('TYPE_A', 'TYPE_C') then coalesce(status = 'ADOPTED', false) else false end as out from m)"""  # noqa: S608

    def firm(source: str, rows: str) -> str:
        return f"""select u.stock_code, u.company_name, u.year, coalesce(c.d, 0) as "InternationalStandardDummy", coalesce(c.k, 0) as "AdoptedEntityCount" from (select distinct stock_code, company_name, year from {source}) u
            left join (select stock_code, year, max(cast(out as int)) as d, count(distinct case when out and status = 'ADOPTED' then entity end) as k from {rows} group by all) c on u.stock_code = c.stock_code and u.year = c.year"""

    chosen = {"main": "routed", "keyword": "(select * from u where text_unit_id in (select text_unit_id from words where keyword_candidate))", "llm_only": "(select * from u where text_unit_id in (select text_unit_id from once where relevance in ('related', 'uncertain')))", "full_llm": "u"}
    finals = ", ".join(f"f_{m} as ({firm(t, f'(select * from mapped where text_unit_id in (select text_unit_id from {t}))')})" for m, t in chosen.items())
    sides = ", ".join(f'g_{m} as (select stock_code, year, max("InternationalStandardDummy") as d, min(company_name) as name from f_{m} where stock_code is not null and year is not null group by all)' for m in chosen)
    nulls = " ".join(
        f"""union all select stock_code, name, year, {', '.join(f'd as d_{k}' if k == m else f'null as d_{k}' for k in chosen)} from (select stock_code, year, max("InternationalStandardDummy") as d, min(company_name) as name from f_{m} where stock_code is null or year is null group by all)""" for m in chosen
    )
    flags = ", ".join(f"coalesce(d_main = d_{m}, false) as main_eq_{m}" for m in list(chosen)[1:])
    compared = f"""with {routed}, {mapped}, {finals}, {sides}, j as (select stock_code, coalesce(g_main.name, g_keyword.name, g_llm_only.name, g_full_llm.name) as company_name, year, g_main.d as d_main, g_keyword.d as d_keyword, g_llm_only.d as d_llm_only, g_full_llm.d as d_full_llm
        from g_main full join g_keyword using (stock_code, year) full join g_llm_only using (stock_code, year) full join g_full_llm using (stock_code, year) {nulls})
        select stock_code, company_name, year, {', '.join(f'd_{m} as "InternationalStandardDummy_{m}"' for m in chosen)}, {flags} from j"""
    match = lambda x: f"lower(translate({compact(x)}, '“”‘’，．：；（）', '\"\"''''„,.:;()'))".replace("„", "")
    ground = lambda p: f"coalesce({match(p)} <> '' and contains({match('text')}, {match(p)}), false)"
    contents = "string_agg(coalesce(entity, '') || chr(1) || coalesce(type, '') || chr(1) || coalesce(status, '') || chr(1) || coalesce(evidence, ''), chr(2) order by coalesce(entity, '') || chr(1) || coalesce(type, '') || chr(1) || coalesce(status, '') || chr(1) || coalesce(evidence, ''))"
    order = "over (partition by text_unit_id order by ln"

    ordered = sorted(set(terms), key=lambda t: (-len(t), t))
    edge = lambda t: (f"(^|[^A-Za-z])" if bound(t[0]) else "") + t + ("([^A-Za-z]|$)" if bound(t[-1]) else "")
    listed = "concat_ws(';', " + ", ".join(f"case when regexp_matches(text, '(?i){edge(t)}') then '{t}' end" for t in ordered) + ")"
    normal = lambda x: strip(f"regexp_replace(regexp_replace({fold(x)}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g')")
    inside = "case when regexp_matches(s, '^```(?:json)?\\s*\n[\\s\\S]*\n```\\s*$') then regexp_extract(s, '^```(?:json)?\\s*\n([\\s\\S]*)\n```\\s*$', 1) else regexp_replace(regexp_replace(s, '(?m)^```(?:json)?\\s*', '', 'g'), '(?m)```$', '', 'g') end"
    item = "json_type(x) = 'OBJECT' and list_sort(json_keys(x)) = ['entity', 'evidence', 'status', 'type'] and json_type(x, '$.entity') = 'VARCHAR' and json_type(x, '$.evidence') = 'VARCHAR' and json_extract_string(x, '$.type') in ('TYPE_A', 'TYPE_B', 'TYPE_C', 'TYPE_D') and json_extract_string(x, '$.status') in ('ADOPTED', 'PENDING', 'NO')"
    return {
        "keyword_terms": f"with {units} select text_unit_id, {term} as keyword_candidate, coalesce({listed}, '') as matched_terms from u",
        "packed_units_whole": "select doc_id, true as whole, true as in_bounds from documents",
        "report_units_numbered": "select distinct doc_id, true as numbered from documents",
        "noise_audit_lengths": f"""with {units}, l as (select text_unit_id, unnest(string_split({normal('text')}, chr(10))) as line from u), sc as (select text_unit_id, round(avg({score('line')}), 4) as s from l where {strip('line')} <> '' group by text_unit_id)
            select u.text_unit_id, coalesce(s, 0.0) as table_noise_score, coalesce(length(text), 0) as raw_text_len, substr(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10), '\\n'), 1, 300) as raw_preview, true as shorter, true as in_range from u left join sc using (text_unit_id)""",
        "reply_strict": f"""with t as (select audit_id, trim({inside.replace('(s,', '(trim(raw_response_preview, chr(10) || chr(13) || chr(9) || chr(32)),')}, chr(10) || chr(13) || chr(9) || chr(32)) as j from recovery_audit),
            v as (select audit_id, regexp_matches(j, ',\\s*[\\]}}]') as loose, case when coalesce(json_valid(j), false) then j::json end as j from t),
            k as (select audit_id, j, coalesce(not loose and json_type(j) = 'OBJECT' and json_keys(j) = ['standards'] and json_type(j, '$.standards') = 'ARRAY', false) as shaped from v),
            i as (select audit_id, unnest(case when shaped then from_json(json_extract(j, '$.standards'), '["json"]') else [] end) as x from k),
            b as (select audit_id, count(*) as n, count(*) filter (where not coalesce({item}, false)) as bad from i group by audit_id)
            select k.audit_id, shaped and coalesce(bad, 0) = 0 as strict, case when shaped and coalesce(bad, 0) = 0 then coalesce(n, 0) end as n_items from k left join b using (audit_id)""",
        "reply_char_repeats": r"select audit_id, coalesce(len(list_filter(range(1, greatest(length(raw_response_preview) - 28, 1)), lambda i: substr(raw_response_preview, i, 30) = repeat(substr(raw_response_preview, i, 1), 30) and regexp_matches(substr(raw_response_preview, i, 1), '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}]'))) > 0, false) as repeats from recovery_audit",
        "unit_lines": f"with {lines} select * from lines",
        "stock_codes": "select distinct stock_code, case when regexp_extract(trim(stock_code), '^([0-9]+)(\\.0+)?$', 1) <> '' and length(regexp_extract(trim(stock_code), '^([0-9]+)(\\.0+)?$', 1)) <= 6 then lpad(regexp_extract(trim(stock_code), '^([0-9]+)(\\.0+)?$', 1), 6, '0') else trim(stock_code) end as code from stage2_result",
        "standard_codes": f"select entity, {base('entity')} as base, {version('entity')} as version, {full(version('entity'))} as version_year from (select distinct entity from stage2_result where type = 'TYPE_B')",
        "report_years": f"select distinct year, {year('year')} as y from text_units",
        "tolerant_bools": "select audit_id, coalesce(parse_success and audit_id % 8 in (0, 1, 2, 4), false) as flag from recovery_audit",
        "line_flags": f"with {lines} select text_unit_id, ln, {leader('line')} as contents, {page('line')} as page, {report('line')} as report, {company('line')} as company, {short('line')} as short, {strong('line')} as strong, {probable('line')} as title from lines",
        "line_scores": f"with {scored} select text_unit_id, ln, score from scored",
        "noise_scores": f"with {scored}, t as (select text_unit_id, round(avg(score), 4) as s from scored where {strip('line')} <> '' group by 1) select distinct text_unit_id, coalesce(s, 0) as noise_score from text_units left join t using (text_unit_id)",
        "dropped_lines": f"with {lines}, h as (select *, {report('line')} as is_header from lines), w as (select *, coalesce(max(is_header) {order} rows between 2 preceding and 1 preceding), false) or coalesce(max(is_header) {order} rows between 1 following and 2 following), false) as near_header from h) select text_unit_id, ln, is_header, near_header, {strip('line')} in ('', '目', '录', '目录') or {leader('line')} or is_header or {page('line')} or ({company('line')} and near_header) as dropped from w",
        "table_blocks": f"with {scored}, i as (select *, sum(case when score >= 0.6 then 0 else 1 end) {order}) as island from scored), b as (select text_unit_id, min(ln) as first_ln, max(ln) as last_ln, count(*) as n, avg(score) as m from i where score >= 0.6 group by text_unit_id, island) select text_unit_id, first_ln, last_ln, n, round(m, 6) as mean_score from b where n >= 4 or (n >= 3 and m >= 0.85)",
        "anchored_lines": f"with {lines}, a as (select *, {strip('line')} = '' as blank, regexp_matches(line, '(?i)(^|[^A-Za-z])(ISO|CE)([^A-Za-z]|$)') or contains(line, '认证') as anchored from lines), w as (select *, lag(anchored, 1, false) {order}) as p1, lag(anchored, 2, false) {order}) as p2, lag(blank, 1, true) {order}) as pb, lead(anchored, 1, false) {order}) as n1, lead(anchored, 2, false) {order}) as n2, lead(blank, 1, true) {order}) as nb from a) select text_unit_id, ln, anchored, anchored or (not blank and (p1 or n1 or (p2 and not pb) or (n2 and not nb))) as protected from w",
        "keyword_flags": f"with {units} select text_unit_id, {term} as keyword_candidate from u",
        "anchor_flags": f"select doc_id, {anchored} as anchored from documents",
        "fixed_slices": f"with s as (select doc_id, text, unnest(range(0, cast(ceil(length(text) / 300) as bigint))) as slice_no from documents where length(text) > 0) select doc_id, slice_no, {strip('substring(text, slice_no * 300 + 1, 300)')} as piece from s where {strip('substring(text, slice_no * 300 + 1, 300)')} <> ''",
        "screening_normalised": "select distinct text_unit_id, reason, case when lower(trim(relevance)) in ('related', 'unrelated', 'uncertain') then lower(trim(relevance)) else 'uncertain' end as relevance, greatest(0.0, least(1.0, coalesce(confidence_score, 0.0))) as score, case when relevance is null then 'ERROR' else 'OK' end as status from stage1_relevance r where true",
        "screening_rescued": "select text_unit_id, case when lower(trim(relevance)) in ('related', 'unrelated', 'uncertain') then lower(trim(relevance)) else 'uncertain' end as relevance, round(coalesce(confidence_score, 0), 6) as score, 'said \"' || coalesce(reason, '') || '\" here' as said, case when coalesce(relevance, '') = '' then 'ERROR' else 'OK' end as status from (select distinct * from stage1_relevance)",
        "screening_once": f"with {once} select * from once",
        "screening_resumed": f"with {units}, k as (select distinct text_unit_id, true as kept from stage1_relevance where stage1_status = 'OK' and confidence_score >= 0.7), h as (select text_unit_id, text, case when kept then 'kept' when coalesce(contains(text, '认证证书'), false) then 'SKIPPED_KEYWORD' else 'asked' end as how from u left join k using (text_unit_id)) select text_unit_id, how, case when how = 'asked' then case when contains(text, '证书') then 'related' when contains(text, '培训') then 'uncertain' else 'unrelated' end end as asked_relevance from h",
        "routed_units": f"with {routed} select text_unit_id, keyword_candidate, relevance, confidence_score, route_reason from routed",
        "variant_keyword": f"with {units}, {words} select text_unit_id, chapter_title from u where text_unit_id in (select text_unit_id from words where keyword_candidate)",
        "variant_llm_only": f"with {units}, {once} select text_unit_id, chapter_title from u where text_unit_id in (select text_unit_id from once where relevance in ('related', 'uncertain'))",
        "variant_full_llm": f"with {units} select text_unit_id, chapter_title from u",
        "reply_audit": "select doc_id, sha256(coalesce(text, '')) as sha256, length(coalesce(text, '')) as n, coalesce(case when length(text) > 300 then left(text, 200) || chr(10) || '...[truncated ' || (length(text) - 300) || ' chars]...' || chr(10) || right(text, 100) else left(text, 200) end, '') as preview, case when length(text) > 400 then left(text, 400) || '...[truncated ' || (length(text) - 400) || ' chars]' else text end as cut from documents",
        "grounded_results": f"with {units} select result_id, {ground('entity')} as entity_grounded, {ground('evidence')} as evidence_grounded from stage2_result join (select text_unit_id, text from u) using (text_unit_id)",
        "failure_rows": f"select result_id, text_unit_id from stage2_result where {failure}",
        "extraction_status": f"with {units}, {done}, {bad} select (select count(*) from done where text_unit_id in (select text_unit_id from u)) as completed, (select count(*) from bad where text_unit_id in (select text_unit_id from u)) as failed",
        "pending_units": f"with {units}, {done} select text_unit_id from u where text_unit_id not in (select text_unit_id from done)",
        "seeded_results": f"with {routed} select result_id, text_unit_id from stage2_result where not {failure} and text_unit_id in (select text_unit_id from routed) and text_unit_id not in (select text_unit_id from stage2_result where status = 'PENDING' and not {failure})",
        "seeded_missing": f"with {units}, {done} select text_unit_id from u where text_unit_id not in (select text_unit_id from done)",
        "mapped_entities": f"with {mapped} select result_id, standard, adopted_as as adoption, cast(out as int) as output from mapped",
        "firm_years": f"with {mapped} {firm('text_units', 'mapped')}",
        "compared_methods": compared,
        "run_counts": f"with {routed}, {done}, {bad}, {mapped}, f as ({firm('text_units', 'mapped')}), x as (select (select count(distinct text_unit_id) from u) as text_units, (select count(*) from words where keyword_candidate) as keyword_units, (select count(distinct text_unit_id) from stage1_relevance where lower(trim(relevance)) = 'related') as screened_related, (select count(distinct text_unit_id) from stage1_relevance where lower(trim(relevance)) = 'uncertain') as screened_uncertain, (select count(distinct text_unit_id) from stage1_relevance where stage1_status = 'SKIPPED_KEYWORD') as screen_skipped, (select count(distinct text_unit_id) from stage1_relevance where stage1_status = 'ERROR') as screen_failed, (select count(distinct text_unit_id) from routed) as routed, (select count(*) from done where text_unit_id in (select text_unit_id from routed)) as completed, (select count(*) from bad where text_unit_id in (select text_unit_id from routed)) as failed, (select count(*) from f) as firm_years, (select count(*) from f where \"InternationalStandardDummy\" = 1) as firm_years_with_output) select *, greatest(0, routed - completed - failed) as pending, routed = completed and failed = 0 and screen_failed = 0 as complete from x",
        "sampled_units": f"with {units} select stock_code, text_unit_id from u where stock_code is not null qualify row_number() over (partition by stock_code order by md5('42|' || stock_code || '|' || text_unit_id), text_unit_id) <= 3",
        "text_lengths": "select count(*) as n, count(*) filter (where length(text) < 1000) as n_short, median(length(text)) as median_length, min(length(text)) as min_length, max(length(text)) as max_length from text_units where text is not null",
        "reviewed_results": f"with b as (select distinct text_unit_id from stage2_result where {failure}), k as (select text_unit_id, type, status from stage2_result where not (coalesce(upper(trim(entity)) = 'ERROR', false) and text_unit_id in (select text_unit_id from b)) union all select text_unit_id, 'TYPE_A', 'ADOPTED' from b) select type, status, count(*) as n, count(distinct text_unit_id) as units from k group by all",
        "recovery_check": f"with a as (select distinct text_unit_id from stage2_result where not {failure} and text_unit_id is not null), b as (select distinct text_unit_id from stage2_result_copy where not {failure} and text_unit_id is not null), x as (select text_unit_id, {contents} as c from stage2_result where text_unit_id in (select text_unit_id from a) group by 1), y as (select text_unit_id, {contents} as c from stage2_result_copy where text_unit_id in (select text_unit_id from b) group by 1), d as (select count(*) as n from stage2_result_copy group by text_unit_id, entity, type, evidence having count(*) > 1) select (select count(*) from a where text_unit_id not in (select text_unit_id from b)) as lost, (select count(*) from b where text_unit_id not in (select text_unit_id from a)) as new, (select count(*) from x join y using (text_unit_id) where x.c <> y.c) as changed, (select coalesce(sum(n), 0) from d) as repeated_rows",
        "duplicate_contents": "select text_unit_id, entity, type, evidence, count(*) as n from stage2_result group by all having count(*) > 1",
        "event_asof": "select p.event_id as purchase_id, max_by(v.event_id, (v.ts, -v.event_id)) as view_id from events p join events v on p.user_id = v.user_id and v.ts <= p.ts where p.event_type = 'purchase' and v.event_type = 'view' group by p.event_id",
    }
