import numpy as np
from pyspark.sql import functions as F

from docmill.llm import catalogue, ngram, repetition, scan_noise
from docmill.llm.rolling import code_points


def _reply(evidence):
    return '{"standards": [{"entity": "ISO 1", "type": "TYPE_A", "status": "NO", "evidence": "' + evidence + '"}]}'


NORMAL = ["本公司完成换版审核，产线同步更新，记录完整。", "质量管理部组织培训，参训人员来自各地工厂和实验室。", "上半年客户满意度较上年同期变动，订单结构有所改善。", "为适应法规变化，事业部调整方案，交付周期明显缩短。"]


def test_share_of_repeated_content():
    share = lambda t: repetition.repeated_share(t)
    assert share(None) == share("") == 0 and share(_reply("".join(NORMAL))) == 0
    assert share(_reply(NORMAL[0] + NORMAL[1] * 9)) > 0.7
    assert share(_reply(NORMAL[0] + "0" * 500)) > 0.9  # a loop of figures
    assert share(_reply("的" * 500)) > 0.9 and share(_reply(NORMAL[0] + "，" * 500)) > 0.9
    loops = "".join(f"第{i}期，客户投诉闭环，完成{i}次；" * 1 for i in range(60))
    assert share(_reply(loops)) > 0.8  # only the figures differ
    frame = '{"entity": "", "type": "TYPE_A", "status": "NO", "evidence": ""}, ' * 50
    assert share('{"standards": [' + frame + _reply(NORMAL[0])) < 0.5


def _brute_share(text, span):
    codes, kind = repetition.content(text)
    letters = [c for c, k in zip(codes.tolist(), kind) if k]
    hit = [False] * len(letters)
    for i in range(len(letters) - span + 1):
        if any(letters[j : j + span] == letters[i : i + span] for j in range(i)):
            hit[i : i + span] = [True] * span
    return hit


def test_coverage_equals_brute_force():
    text = _reply(NORMAL[0] + NORMAL[1] + NORMAL[0] + NORMAL[2] + NORMAL[1][3:])
    codes, kind = repetition.content(text)
    assert repetition._covered(codes[kind == 1], 12).tolist() == _brute_share(text, 12)


def test_probabilities_add_up(spark):
    texts = spark.createDataFrame([("zh", t * k) for k, t in enumerate(NORMAL, 1)], "lang string, t string")
    counted = ngram.count_grams(texts, lambda t: code_points(t), "lang", "t")
    tables = ngram.fit(counted)
    model = ngram.arrays(tables)["zh"]
    chars = sorted({c for t in NORMAL for c in t})
    for context in (NORMAL[0][:3], NORMAL[2][4:7], "无此文", "\0\0\0"):
        head = [ord(c) for c in context]
        grams = np.array([(head[0] << 48) | (head[1] << 32) | (head[2] << 16) | ord(c) for c in chars], dtype=np.uint64)
        assert 0.9 < model.probability(grams).sum() < 1.1
    assert ngram.arrays(tables, most=20) is None
    asked = [(int(g), "zh") for g in np.concatenate([grams, grams >> np.uint64(16), grams ^ np.uint64(0x41 << 16)]).view(np.int64)]
    joined = {r["gram"]: r["p"] for r in ngram.look_up(spark.createDataFrame(asked, "gram long, lang string"), tables).collect()}
    assert all(abs(joined[g] - p) < 1e-6 for (g, _), p in zip(asked, model.probability(np.array([g for g, _ in asked], dtype=np.int64).view(np.uint64))))
    head, complete = ngram.frequent(tables[-1], most=20)
    assert not complete and sum(len(keys) for keys, _ in head.values()) <= 20


def test_languages():
    assert [repetition.language(t) for t in (NORMAL[0], "The board of the company is in Paris.", "Das ist nicht der Vertrag und die Bank.", "Le conseil des ventes et la banque est dans le", "Это проверка качества", "これはテストです", "12 34", "QX ZV")] == ["zh", "en", "de", "fr", "ru", "ja", "none", "latin"]


def test_rare_grams_are_joined_with_the_same_result(spark, monkeypatch):
    rows = [(i, _reply(NORMAL[i % 4] + NORMAL[(i + 1) % 4] * (1 + i % 3 * 4) + "字" * (i % 5))) for i in range(40)] + [(3, _reply(NORMAL[3] + NORMAL[0] * 5)), (90, None), (91, "")]
    df = spark.createDataFrame(rows, "audit long, p string")
    run = lambda: sorted((r["audit"], r["lang"], round(r["log_ppl"], 4), round(r["memory_log_ppl"], 4), r["band"], round(r["repeated_share"], 4)) for r in repetition.repetition(df, "audit", "p", repetition.FRAME).collect())
    whole = run()
    monkeypatch.setattr(ngram, "BROADCAST_ENTRIES", 30)
    assert run() == whole and len(whole) == len(rows)


def test_bands_find_loops(spark):
    normal = [(i, _reply(NORMAL[i % 4] + NORMAL[(i // 4) % 4] * (i % 4 != (i // 4) % 4) + NORMAL[(i // 16) % 4] * (i // 16 % 4 not in (i % 4, i // 4 % 4)) + "编号" + "甲乙丙丁戊己庚辛"[i % 8] + "完成全部整改工作并归档备查，后续安排另行通知。")) for i in range(120)]
    loops = [(500 + i, _reply(NORMAL[i % 4] + NORMAL[(i + 1) % 4] * 15)) for i in range(20)]
    df = spark.createDataFrame(normal + loops + [(900, None), (901, "")], "audit long, p string").withColumn("i", F.lit(1)).withColumn("lang", F.lit("x"))
    got = {r["audit"]: r for r in repetition.repetition(df, "audit", "p", repetition.FRAME).collect()}
    assert len(got) == 142 and got[900]["band"] == got[901]["band"] == "ok"
    assert all(got[i]["band"] == "low" and got[i]["repeated_share"] > 0.5 for i, _ in loops)
    assert all(got[i]["repeated_share"] < 0.5 for i, _ in normal)
    assert repetition.repetition(df.limit(0), "audit", "p", repetition.FRAME).count() == 0


def test_loops_with_changed_marks_and_few_copies_are_found(spark, tmp_path):
    filler = ["甲乙丙丁戊己庚辛"[i % 8] + "线" + "东南西北中"[i % 5] + "区" for i in range(120)]
    normal = [(i, _reply(filler[i] + NORMAL[i % 4] + NORMAL[(i + 1 + i // 4 % 3) % 4] + "完成全部整改工作并归档备查，后续安排另行通知。")) for i in range(120)]
    words = NORMAL[1].rstrip("。").split("，")
    changed = [(500 + i, _reply("".join(w + "，。；、！：~|·？"[(i + 7 * j + j * j) % 10] for j, w in enumerate(words * 12)))) for i in range(5)]
    few = [(600 + i, _reply(NORMAL[i] * 3)) for i in range(4)]
    df = spark.createDataFrame(normal + changed + few, "audit_id long, raw_response_preview string")
    df.write.parquet(str(tmp_path / "recovery_audit.parquet"))
    got = {r["audit_id"] for r in catalogue.p1_found(spark, str(tmp_path)).collect()}
    assert got == {i for i, _ in changed + few}
    measured = {r["i"]: r["band"] for r in repetition.repetition(df.withColumnRenamed("audit_id", "i"), "i", "raw_response_preview", repetition.FRAME).collect()}
    assert all(measured[i] == "low" for i, _ in changed)


def test_memory_is_the_same_whatever_the_marks():
    words = NORMAL[1].rstrip("。").split("，")
    mean = lambda t: np.mean(repetition.foreseen([c := repetition.content(t, None)], np.zeros(len(c[0]), np.int64), np.arange(len(c[0])))[0])
    plain, changed = "，".join(words * 6), "".join(w + "，。；、！：~|·？"[(7 * j + j * j) % 10] for j, w in enumerate(words * 6))
    assert mean(changed) > 0.95 * mean(plain) > 0.7 and mean("".join(NORMAL)) < 0.05
    assert mean(NORMAL[0] + "，" * 500) > 0.9


def test_memory_ranks():
    streams = [code_points("abcdefgabcdefg"), code_points("abcdefg")]
    row, at, _ = ngram.packed(streams)
    p, known = repetition.memory_probability(streams, row, at)
    assert known[12:14].all() and p[13] == 1.0 and not known[14:].any()


NAMES = ["霁图电子科技股份有限公司"]


def test_page_structure():
    text = "公司引入Quality Manage-\nment System，用于规范\n霁图电子科技  2024 年度报告\n— 17 —\n来料检验。相关情况详见公司\n2019年年度报告全文第4页。\n\n（一）质量管理\n单位：万元\n轨道扣件  5,748.50  8,703.60  36.19\n霁图电子科技股份有限公司　公司治理\n末行"
    body, kinds = scan_noise.page_structure(text, NAMES, "管理层讨论与分析")
    assert kinds == {"hyphen_break", "running_header", "page_number"}
    assert body.startswith("公司引入Quality Management System，用于规范来料检验。相关情况详见公司2019年年度报告全文第4页。\n\n（一）质量管理\n单位：万元\n轨道扣件")
    clean = "State-of-the-art equipment。\n产量为\n12吨。"
    assert scan_noise.page_structure("State-\nof-the-art equipment.", NAMES, "")[1] == set()  # a compound, not a divided word
    assert scan_noise.page_structure(clean, NAMES, "")[1] == set()


def test_headers_of_english_reports():
    header = lambda x: scan_noise.is_running_header(x, "", NAMES, "")
    assert all(header(x) for x in ("Company Annual Report 2025", "  Jitu Electronics Co. 2019 Annual Report", "ANNUAL REPORT 2020"))
    assert not any(header(x) for x in ("The Annual Report 2025 was published in March.", "Annual Report", "see Annual Report 2020 for details"))


def test_titles():
    t = lambda s: scan_noise.clean_title(s, NAMES)
    assert t("第四节 公司治理......180") == ("第四节 公司治理", {"page_number"}) and t("第四节 公司治理 - 6 -")[1] == {"page_number"} and t("第四节 公司治理 第24页")[1] == {"page_number"}
    assert t("第六节 重要事项 霁图电子科技股份有限公司") == ("第六节 重要事项", {"running_header"})
    assert t("霁图电子科技股份有限公司2020年年度报告 第六节 重要事项") == ("第六节 重要事项", {"running_header"}) and t("2022年年度报告全文 第三节 管理层讨论与分析")[1] == {"running_header"}
    assert t("第五节　环境和社会责任")[1] == set() == t("第四节公司治理")[1] and t(None) == ("", set())


def test_repair(spark):
    base = "报告期内公司围绕产品建立质量管理体系，覆盖检验。年末人员培训完成，数据可查可追。The share reached quality 2018."
    bad = {1: base.replace("管理体系", "管埋休系"), 2: base.replace("quality", "qua1ity"), 3: base.replace("2018", "2O18"), 4: base}
    rows = [(f"u{i}", base, "第四节 公司治理", NAMES[0], None) for i in range(10, 90)] + [(f"u{i}", t, "第四节 公可治埋" if i == 1 else "第四节 公司治理", None, "1_霁图电子科技股份有限公司_2024年年度报告.txt") for i, t in bad.items()] + [("n", None, None, None, None), ("e", "", "", "", "")]
    df = spark.createDataFrame(rows, "unit string, text string, chapter_title string, company_name string, source_file string").withColumn("i", F.lit(1)).withColumn("kinds", F.lit(1))
    got = {(r["unit"], r["field_name"]): r for r in scan_noise.repair_scans(df, "unit", "text", "chapter_title", "company_name", "source_file").collect()}
    assert len(got) == 2 * len(rows)
    assert {k for k, r in got.items() if r["kinds"]} == {("u1", "text"), ("u2", "text"), ("u3", "text"), ("u1", "chapter_title")}
    assert all(got[f"u{i}", "text"]["repaired"] == base for i in bad) and got["u1", "chapter_title"]["repaired"] == "第四节 公司治理"
    assert got["n", "text"]["repaired"] is None and got["e", "text"]["repaired"] == ""
    assert scan_noise.repair_scans(df.limit(0), "unit", "text", "chapter_title", "company_name", "source_file").count() == 0


def test_words_are_compared_by_their_true_counts_alone(spark):
    pages = [("a", "text", "rnanagement 2O18 certiflcate clear qua1ity management " + "management quality certificate 2018 2017 2016 2015 2014 2013 2012 2011 2010 2009 " * 12 + "clear dear dear")]
    meant = scan_noise._misread_words(spark.createDataFrame(pages, "i string, field string, body string")).head()["meant"]
    assert meant == {"rnanagement": "management", "2O18": "2018", "certiflcate": "certificate", "qua1ity": "quality"}
    rows = [(f"a{i}", "the " * 100) for i in range(120)] + [(f"b{i}", "tbe " * 55) for i in range(20)] + [(f"c{i}", "head word") for i in range(15)] + [("d", "bead bead"), (None, "tbe"), ("b0", "tbe 7")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "u string, text string, h string, c string, f string")
    got = [(r["u"], r["repaired"], r["kinds"]) for r in scan_noise.repair_scans(df, "u", "text", "h", "c", "f").collect() if r["field_name"] == "text"]
    assert len(got) == len(rows) and {u for u, _, k in got if k} == {f"b{i}" for i in range(20)} | {None}
    assert not any("tbe" in t for _, t, _ in got) and ("d", "bead bead", []) in got and ("b0", "the 7", ["ocr_char"]) in got


UNSEEN = {"检": "捡", "质": "盾", "流": "浣", "部": "陪", "货": "赁", "查": "杳", "末": "耒"}  # pairs that no table lists


def test_misreadings_of_unlisted_pairs_are_learned_from_the_corpus(spark):
    assert not any(wrong in scan_noise.MISREAD for wrong in UNSEEN.values())
    places = ["东", "南", "西", "北", "中", "前", "后", "左", "右", "上"]
    words = [f"{p}部检验流程由质量组负责，货物入库前须经复查，期末汇总。" for p in places] + [f"{p}区完成质量检查，流转记录交采购部，货款于期末付清。" for p in places]
    rows, planted = [], set()
    for i in range(600):
        text = words[i % len(words)] + words[(i * 7 + 3) % len(words)]
        if i % 15 == 0:
            right, wrong = list(UNSEEN.items())[i // 15 % len(UNSEEN)]
            if right in text:
                text = text.replace(right, wrong, 1)
                planted.add(f"u{i}")
        rows.append((f"u{i}", text, None, None, None))
    df = spark.createDataFrame(rows, "unit string, text string, title string, company string, file string")
    for most in (None, 0):  # broadcast, and joined
        got = {r["unit"] for r in scan_noise.repair_scans(df, "unit", "text", "title", "company", "file", most).where("array_contains(kinds, 'ocr_char')").collect()}
        assert len(got & planted) >= 0.95 * len(planted) > 30 and got <= planted, most


def test_figures_of_tables_stay():
    text = "单位：万元\n120\n2024\n3/4\n98\n合计完成。"
    body, kinds = scan_noise.page_structure(text, NAMES, "")
    assert kinds == set() and all(x in body for x in ("120", "2024", "3/4", "98"))
    assert scan_noise.page_structure("公司持续改进\n57\n过程控制。", NAMES, "") == ("公司持续改进过程控制。", {"page_number"})
