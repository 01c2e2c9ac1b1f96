import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.llm import leak
from docmill.llm.chunk import split_oversized, split_text
from docmill.llm.rolling import code_points, folded, sub_batches, text_of, windows


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="甲乙。\n ,.a第一章", max_size=300), st.integers(12, 60), st.integers(0, 10))
def test_pieces_put_together_are_the_text(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert all(len(p) <= limit for p in pieces)
    assert "".join([pieces[0], *(p[overlap:] for p in pieces[1:])]) == text
    assert all(b[:overlap] == a[-overlap:] if overlap else True for a, b in zip(pieces, pieces[1:]))
    assert len(pieces) == 1 or len(text) > limit


def test_cuts_at_natural_boundaries():
    text = "\n".join(["一" * 30 + "。"] * 6)
    assert [p[-1] for p in split_text(text, 80, 10)[:-1]] == ["\n"] * (len(split_text(text, 80, 10)) - 1)
    flat = ("二" * 30 + "。") * 6
    assert all(p.endswith("。") for p in split_text(flat, 80, 10))
    assert max(map(len, split_text("三" * 1000, 80, 10))) == 80


def test_split_rows(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "短", 7), (4, "长。" * 2000, 7), (4, "长。" * 2000, 7)], "i int, t string, pieces int")
    got = split_oversized(df, "t", 1200, 100)
    by = {(r["i"], r["_pieces"]) for r in got.collect()}
    assert {b for b in by if b[0] < 4} == {(1, 1), (2, 1), (3, 1)} and got.where("i = 4 and piece_no = 1").count() == 2
    assert got.where("i = 4").select("pieces").distinct().head()[0] == 7
    assert split_oversized(df.limit(0), "t").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "t", 10, 10)


def test_windows_tell_texts_apart():
    a = windows(code_points("abcabcx"), 3)
    assert a[0] == a[3] and len(set(a.tolist())) == 4 and len(windows(code_points("ab"), 3)) == 0
    assert text_of(folded("ＡＢ c，1２")) == "abc12"


def test_sub_batches():
    import pandas as pd

    pdf = pd.DataFrame({"t": ["a" * 5, None, "b" * 20, "c", ""]})
    parts = list(sub_batches(pdf, "t", 8))
    assert sum(map(len, parts)) == 5 and [len(p) for p in parts] == [2, 1, 2]


def _brute(docs, items, run):
    out = set()
    for d, t in docs:
        f = text_of(folded(t or ""))
        for i, x in items:
            g = text_of(folded(x or ""))
            if any(g[k : k + run] in f for k in range(len(g) - run + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_leaks_equal_brute_force(spark, monkeypatch, small):
    if small:  # the index is joined by a shuffle
        monkeypatch.setattr(leak, "BROADCAST_ROWS", 1)
    r = random.Random(3)
    words = ["压接模具", "某风电整机厂", "尺寸漂移", "降至37例", "Quality", "复核", "21.4个", "盲样", "并说明", "等级"]
    text = lambda n: "，".join(r.choice(words) for _ in range(n))
    items = [(i, text(40)) for i in range(12)] + [(90, None), (91, ""), (92, "短")]
    docs = []
    for d in range(40):
        t = text(30)
        if d % 3 == 0:
            src = items[d % 12][1]
            a = r.randrange(len(src) // 2)
            t = t[:40] + src[a : a + r.choice([40, 60, 75, 120])].upper().replace("，", " ; ") + t[40:]
        docs.append((d, t))
    docs += [(100, None), (101, ""), (102, items[0][1]), (103, items[0][1])]
    run = lambda d, i: leak.leaked_items(spark.createDataFrame(d, "doc long, text string").withColumn("h", F.lit(1)), "doc", "text", spark.createDataFrame(i, "item long, text string"), "item", "text")
    figures = "".join(str(r.randrange(10)) for _ in range(70))
    lists = "、".join(str(r.randrange(100, 9999)) for _ in range(40))
    firms = "".join(f"某{r.choice('东西南北')}{r.choice('山川河海')}电子厂" for _ in range(20))
    items += [(200, "前文" + figures + "后文"), (201, lists), (202, firms), (203, "一" * 80)]
    docs += [(300, "数据" + figures), (301, "表：" + lists[20:]), (302, "名单" + firms[3:70]), (303, "另" + firms[40:]), (304, "一" * 300), (305, figures[:49])]
    got = {(x["doc"], x["item"]) for x in run(docs, items).where("verbatim_run >= 50").collect()}
    assert got == _brute(docs, items, 50) and {(300, 200), (301, 201), (302, 202), (304, 203)} <= got
    assert run(docs[:0], items).count() == 0 and run(docs, items[:0]).count() == 0


def test_reworded_items_are_told_apart(spark):
    item = "对照组因仪表借调采取重设比色光源，停产检修前组隔着防尘罩采取加装消声罩，两组相差77个等级，焊缝夹渣降至50例，噪声异常仍在，请判断上述陈述"
    docs = spark.createDataFrame([(1, item), (2, item.replace("77", "81").replace("50", "3"))], "doc long, text string")
    got = {r["doc"]: r for r in leak.leaked_items(docs, "doc", "text", spark.createDataFrame([(5, item)], "item long, text string"), "item", "text").collect()}
    assert not got[1]["reworded"] and got[2]["reworded"] and got[2]["slots_equal"] < got[2]["slots"]


def test_slots_must_be_consistent():
    item = "某电子厂去年生产了77台设备，今年计划仍为77台，产量的合格率为90，返修率为50，问该厂两年合计生产多少台合格设备，并说明返修的原因和改进的措施"
    same = item.replace("77", "12")
    mixed = item.replace("77", "12", 1)
    assert leak.compare(same, item, [0], 50)[2:] [0] == leak.compare(mixed, item, [0], 50)[2]
    assert leak.compare(same, item, [0], 50)[4] and not leak.compare(mixed, item, [0], 50)[4]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="某电厂公司12三百万个李明abc风力", min_size=50, max_size=120), st.text(alphabet="某电厂公司12三百万个李明abc风力", max_size=30), st.text(alphabet="某电厂公司12三百万个李明abc风力", max_size=30), st.integers(0, 70))
def test_every_passage_has_a_common_window(passage, before, after, at):
    part = passage[min(at, len(passage) - 50) :][:50]
    known = {h for hashes in leak.item_hashes(passage, 50) for h in hashes.tolist()}
    looked_up = {h for _, hashes in leak.document_hashes(before + part + after, 50) for h in hashes.tolist()}
    assert known & looked_up
