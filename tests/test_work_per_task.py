"""The work of a task does not grow with the table, and costly columns are worked out once."""

import pytest
from pyspark.sql import functions as F

from cuework.functions import text as tx
from cuework.operators import ordered as O
from cuework.operators import windows as W
from cuework.plans.segments import select_segments
from cuework.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    lines = spark.range(400).select((F.col("id") % 20).alias("k"), F.col("id").alias("line_index"), (F.col("id") * 3.0).alias("start"),
                                    (F.col("id") * 3.0 + 2).alias("end"))
    segs = lines.select("k").distinct().withColumns({"segment_start": F.lit(0.0), "segment_end": F.lit(1000.0)})
    carve = lambda: sorted(map(str, W.carve_spans(lines, segs, ["k"], min_gap=5.0, longest=9.0).collect()))
    want = carve()
    monkeypatch.setattr(O, "TASK_ROWS", 25)
    split = O.split_hot(lines, ["k"], "start")
    assert split.rdd.getNumPartitions() == 16 and not O.is_split(split)
    hot = O.split_hot(lines, ["k"], "start", hot_rows=5)
    assert hot.rdd.getNumPartitions() == 16 and O.is_split(hot)
    assert carve() == want


def test_rows_of_a_sweep_are_bounded(spark, monkeypatch):
    tracks = spark.createDataFrame([(k, 200.0) for k in range(20)], "k int, duration double")
    at = spark.range(400).select((F.col("id") % 20).cast("int").alias("k"), (F.col("id") / 2.0).alias("t"))
    frames = at.select("k", F.floor("t").alias("frame"), (F.col("t") / 200).alias("energy"))
    sections = at.filter("t % 10 = 0").withColumn("repetition", F.lit(1.0))
    pick = lambda: select_segments(tracks, frames, at, at, sections, ["k"], 30.0)
    want, sizes = sorted(map(str, pick().collect())), []
    place = O.in_tasks
    monkeypatch.setattr(O, "TASK_ROWS", 25)
    monkeypatch.setattr("cuework.plans.segments.in_tasks", lambda df, key, n: sizes.append(n) or place(df, key, n))
    assert sorted(map(str, pick().collect())) == want
    # two sweeps: 35 grid points and the sections of 20 tracks, probed at four places, next to all rows
    assert len(sizes) == 2 and min(sizes) >= 20 * 35 * 4 + 400 * 3


@pytest.mark.parametrize("name", ["w10_word_times", "fn20_wrap_text", "fn20_wrap_measured"])
def test_filters_do_not_repeat_the_work(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [x for x in plan if "Filter" in x and ("split(" in x or "aggregate(" in x)]


def test_white_space_is_what_the_pattern_says(spark):
    chars = spark.createDataFrame([(chr(i),) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000], "c string")
    found = {r.c for r in chars.filter(F.col("c").rlike(r"(?U)^\s$") & (F.length("c") == 1)).collect()}
    assert found | {"\n"} == set(tx.WHITE_SPACE)
    edge = spark.createDataFrame([(f"{c}a {c} b{c}{c}",) for c in sorted(found)], "x string")
    assert {tuple(r) for r in edge.select(tx.strip("x") == F.regexp_replace("x", r"(?U)^\s+|\s+$", "")).collect()} == {(True,)}


def test_stored_alignments_are_spread_by_rows(spark, monkeypatch):
    from cuework.operators import tables as tb
    monkeypatch.setattr(O, "TASK_ROWS", 5)
    row = spark.range(20).select(F.lit(1).alias("k"), F.col("id").alias("line_index"), F.col("id").cast("double").alias("start"),
                                 (F.col("id") + 1.0).alias("end"), F.lit(0.5).alias("confidence"))
    words = row.select("k", "line_index", F.lit("old").alias("text"))
    al = row.filter("line_index < 3").withColumn("start", F.lit(99.0))
    none = spark.createDataFrame([(1, 0.5, 0.5, None)], "k int, matched_ratio double, mean_confidence double, aligned_at timestamp")
    ln, wd, _ = tb.apply_alignment(row, words, al, al.select("k", "line_index", F.lit("new").alias("text")), none, none, ["k"],
                                   F.current_timestamp())
    assert "RepartitionByExpression" in ln._jdf.queryExecution().analyzed().toString()
    assert ln.filter("start = 99").count() == 3 and ln.count() == 20
    assert {(r.text, r["count"]) for r in wd.groupBy("text").count().collect()} == {("old", 17), ("new", 3)}


def test_scenes_meet_texts_by_digest(spark):
    from cuework.operators import joins as J
    from cuework.plans import scenes
    rows = [(1, 0, "love in the night", 1.0, 4.0), (1, 1, "", 5.0, 8.0), (1, 2, None, 9.0, 12.0), (1, 3, "love in the night", 14.0, 19.0),
            (1, 4, "far away", 90.0, 95.0), (1, None, "rain", 20.0, 24.0), (2, 0, "given", 0.0, 9.0), (3, 0, "far away", None, None)]
    lines = spark.createDataFrame(rows, "k int, line_index int, text string, start double, end double").withColumns(
        {"translation": F.lit(None).cast("string"), "uncertain": F.lit(False)})
    segs = spark.createDataFrame([(k, 0.0, 30.0) for k in (1, 2, 3)], "k int, segment_start double, segment_end double")
    tracks = spark.createDataFrame([(k, "a title", 96.0, "automatic") for k in (1, 2, 3)], "k int, title string, tempo_bpm double, style string")
    words, at = lines.select("k", "line_index", "start", "end"), segs.select("k", F.lit(1.0).alias("t"))
    frames = segs.select("k", F.lit(0).alias("frame"), F.lit(0.9).alias("energy"))
    lex = J.lexicon(spark)
    known = J.extract_semantics(spark.createDataFrame([("given",), ("unused",)], "text string"), ["text"], "text", lex).withColumn(
        "subjects", F.array(F.lit("gift")))
    out = scenes.plan_scenes(lines, words, frames, at, at, segs, tracks, lex, ["k"], semantics=known)
    plan = out["scenes"]._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [x for x in plan if "Join" in x and ("(text#" in x or "(lyric#" in x)]
    got = {(r.k, r.line_index): r for r in out["scenes"].filter("line_index IS NOT NULL").collect()}
    assert {k: r.lyric for k, r in got.items()} == {(1, 0): "love in the night", (1, 1): None, (1, 2): None, (1, 3): "love in the night",
                                                    (2, 0): "given"}
    assert got[1, 0].subjects == got[1, 3].subjects != [] and got[2, 0].subjects == ["gift"] and got[1, 1].subjects == []
    near, texts = scenes.near_lines(lines, lines.select("k", "line_index", "start", "end"), segs, ["k"])
    assert near.count() == 6 and sorted(str(r.text) for r in texts.collect()) == ["", "None", "given", "love in the night", "rain"]


def test_words_of_a_text_are_read_in_one_pass(spark, monkeypatch):
    from cuework.operators import joins as J
    odd = ["", None, "  ", "The ION's on_and on x", "été É ẞİI", "a--b\x1cc\x85d e", "''  '", "中文 ٣x \U0001d518z", "\t\x0bon\r\nthen"]
    docs = spark.createDataFrame(list(enumerate(odd)), "id int, x string")
    both = docs.select(tx.semantic_words("x").alias("a"), tx.words_of(tx.semantic_norm("x")).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both] and both[3].a == ["the", "ion's", "on_and", "on", "x"]
    kept, store = [], J.checkpoint
    monkeypatch.setattr(J, "checkpoint", lambda df: kept.append(store(df)) or kept[-1])
    lex = spark.createDataFrame([("on",), ("ion",), ("the",), ("x",)], "stem string")
    got = J.lexicon_join(J.text_tokens(docs, ["id"], "x"), lex, ["id"])
    assert {(r.id, r.stem, r.pos) for r in got.collect()} == {(3, "the", 0), (3, "ion", 1), (3, "on", 2), (8, "on", 0), (8, "the", 1)}
    # what starts like no stem is not stored, nor a single letter
    assert {r.token for r in kept[0].collect()} == {"the", "ion's", "on_and", "on", "then"}
