import pytest
from pyspark.sql import functions as F

from docmill.llm import mixing, pii
from docmill.llm.mixing import mix_sources, mixture_shares, token_counts

TARGETS = [("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.2, 4)]


def _sizes(spark, n=3000):
    src = F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 8, "b").when(F.col("id") % 10 < 9, "c")
    return spark.range(n).select("id", src.alias("source"), (F.pmod(F.xxhash64("id"), F.lit(500)) + 1).alias("n"))


def test_shares_are_met_and_repeats_bounded(spark):
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mix = mix_sources(_sizes(spark), "id", "source", "n", t)
    for r in mixture_shares(mix, "source", "n", t).collect():
        assert r["actual_share"] == pytest.approx(r["target_share"], abs=0.005)
        assert r["most_copies"] <= r["max_repeats"] and r["uses"] >= r["documents"]
    assert mix.select("id").distinct().count() == mix.count()


def test_the_sample_is_the_same_whatever_the_partitions(spark):
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    draw = lambda n: {tuple(r) for r in mix_sources(_sizes(spark).repartition(n), "id", "source", "n", t, total=100_000).collect()}
    assert draw(1) == draw(5)


def test_a_crowded_class_is_divided_again(spark, monkeypatch):
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    draw = lambda: sorted(tuple(r) for r in mix_sources(_sizes(spark), "id", "source", "n", t, total=100_000).collect())
    plain = draw()
    monkeypatch.setattr(mixing, "EDGE_ROWS", 1)
    monkeypatch.setattr(mixing, "RANK_BINS", 4)
    assert draw() == plain


def test_mixing_corner_cases(spark):
    t = spark.createDataFrame([("a", 0.5, 2), ("none", 0.5, 2), (None, 0.1, 1), ("z", None, 3)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame([(1, "a", 10), (1, "a", 10), (2, None, 5), (3, "other", 5), (4, "a", None), (5, "a", 0)], "id long, source string, n long")
    got = mix_sources(df, "id", "source", "n", t, total=80).collect()
    assert sorted((r["id"], r["copies"]) for r in got) == [(1, 2), (1, 2)]
    assert mix_sources(df.limit(0), "id", "source", "n", t).count() == 0 and mix_sources(df, "id", "source", "n", t.limit(0)).count() == 0


def test_larger_documents_are_likelier(spark):
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    df = spark.range(20000).select("id", F.lit("a").alias("source"), F.when(F.col("id") % 2 == 0, 300).otherwise(100).alias("n"))
    got = {r["n"]: r["count"] for r in mix_sources(df, "id", "source", "n", t, total=1_000_000).groupBy("n").count().collect()}
    assert got[300] / got[100] == pytest.approx(3, rel=0.15)


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "中文" * 1000)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", token_counts(F.col("t")).alias("n")).collect()}
    assert got[1] >= 2 and got[2] == got[3] == 0 and got[4] >= 1000


TEXTS = {
    1: ("联系人：欧阳宛白，电话：+86 170 0062 2881。资料可发送到mirel-20+std@ir.qinglan.example，或拨打（0919）55508386核实。", {("name", "欧阳宛白"), ("phone", "+86 170 0062 2881"), ("email", "mirel-20+std@ir.qinglan.example"), ("phone", "（0919）55508386")}),
    2: ("由罗知遥担任内审组长，身份证号997044 19990827 1170，住址为青澜省赤水坪市松涛路671号4单元1764室。", {("name", "罗知遥"), ("id_number", "997044 19990827 1170"), ("address", "青澜省赤水坪市松涛路671号4单元1764室")}),
    3: ("Please write to Tavia Wexcombe at calla_52@yunze.test. Samples are kept at 259 Linden Quay, Suite 58, Marlow Quay and released by Mr Alden Pellow. Ms Mirel Venn (ID no. 987-71-6078) signed.", {("name", "Tavia Wexcombe"), ("email", "calla_52@yunze.test"), ("address", "259 Linden Quay, Suite 58, Marlow Quay"), ("name", "Alden Pellow"), ("name", "Mirel Venn"), ("id_number", "987-71-6078")}),
    4: ("合同流水号261733218719500230，对应批次29738721882。统一社会信用代码91990643MA931829XK已变更登记。证书编号CP-2022-71271有效期至2025年9月。检测点设于石渡市船用泵园区，覆盖@7号线。Batch 2023-80-02154 was released.", set()),
    5: ("档案登记人证件为99978819631207198X，联系电话１７０００８３９５９６。董事会秘书温澄的办公地点在云泽市梧桐里370号A座9层。", {("id_number", "99978819631207198X"), ("phone", "１７０００８３９５９６"), ("name", "温澄"), ("address", "云泽市梧桐里370号A座9层")}),
    6: ("回复邮箱为lina-ir813＠mail.example。Questions may be raised by phone on +1 (555) 010-0196.", {("email", "lina-ir813＠mail.example"), ("phone", "+1 (555) 010-0196")}),
}


def test_values_as_they_stand_and_placeholders(spark):
    rows = [(i, t) for i, (t, _) in TEXTS.items()] * 1 + [(50, None), (51, "")] + [(60 + i, TEXTS[1][0]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc long, text string").withColumn("kind", F.lit("clash"))
    spans = pii.pii_spans(df.drop("kind"), "doc", "text")
    got = {}
    for r in spans.collect():
        got.setdefault(r["doc"], set()).add((r["kind"], r["value"]))
        assert dict(rows)[r["doc"]][r["start"] : r["stop"]] == r["value"]
    assert {i: got.get(i, set()) for i in TEXTS} == {i: w for i, (_, w) in TEXTS.items()}
    clean = {r["doc"]: r["text"] for r in pii.redacted(df, "doc", "text", spans).collect()}
    assert clean[50] is None and clean[51] == "" and clean[4] == TEXTS[4][0]
    assert clean[1] == "联系人：[NAME]，电话：[PHONE]。资料可发送到[EMAIL]，或拨打[PHONE]核实。"
    assert pii.pii_spans(df.limit(0), "doc", "text").count() == 0


def test_estimation_finds_the_unreliable_labeler():
    good, bad = (1, 1, 1, 1, 0), (1, -1, 0, -1, -1)
    p = pii.estimate({("phone", good): 1000, ("phone", bad): 300})
    assert p["phone", good] > 0.9 and p["phone", bad] < 0.5


def test_forms_that_no_table_of_the_project_has():
    proposed = lambda t: {(k, t[a:b]) for k, a, b, _ in pii.label_spans(t)}
    assert ("name", "王小明") in proposed("昨日，王小明到会发言") and ("phone", "020 7946 0018") in proposed("Call 020 7946 0018 now")
    assert ("name", "John Smith") in proposed("My name is John Smith") and ("name", "Anna Weiß") in proposed("Frau Anna Weiß, Tel. +49 30 1234567")


def test_learned_names_are_found_where_they_stand_bare(spark):
    clear = [(i, f"联系人：欧阳宛白，电话：0919-5550838{i}。Mr Alden Pellow signed.") for i in range(6)]
    bare = [(90, "随后欧阳宛白与各方讨论了样品。"), (91, "Later on Alden Pellow left the room."), (92, "与会各方讨论了样品。")]
    spans = pii.pii_spans(spark.createDataFrame(clear + bare, "doc long, text string"), "doc", "text")
    got = {(r["doc"], r["value"]) for r in spans.collect() if r["doc"] >= 90}
    assert got == {(90, "欧阳宛白"), (91, "Alden Pellow")}


def test_classifier_learns_from_form_and_neighbours():
    votes = (1, 0, 0, 0, 0)
    patterns = {("phone", (1, 1, 0, 1, 0), "plain-11-", "colon", "mark"): 500, ("phone", (1, -1, 0, -1, -1), "plain-8-", "letter", "letter"): 500, ("phone", votes, "plain-11-", "colon", "mark"): 5, ("phone", votes, "plain-8-", "letter", "letter"): 5}
    p = pii.estimate(patterns)
    assert p["phone", votes, "plain-11-", "colon", "mark"] > p["phone", votes, "plain-8-", "letter", "letter"] + 0.05


def test_names_after_a_colon_and_dotted_numbers_are_proposed():
    proposed = lambda t: {(k, t[a:b]) for k, a, b, _ in pii.label_spans(t)}
    assert proposed("Contact: Lina Sellick, tel. +1 (555) 010-0192") == {("name", "Lina Sellick"), ("phone", "+1 (555) 010-0192")}
    assert proposed("Orson Thistleby, tel. 555.010.0171. After") == {("name", "Orson Thistleby"), ("phone", "555.010.0171")}
    assert proposed("Released by: Alden Pellow\nWitness: Mirel Venn, phone (555) 010.0171") == {("name", "Alden Pellow"), ("name", "Mirel Venn"), ("phone", "(555) 010.0171")}
    assert proposed("call +1.555.010.0171 or 138.1234.5678") == {("phone", "+1.555.010.0171"), ("phone", "138.1234.5678")}
    assert proposed("Firmware v9.9.9.9999, address 192.168.001.1234, share 555.010.0171.2 and Contact Lens audit") == set()
