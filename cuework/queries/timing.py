"""Window operators, aggregates and time joins over ``events`` (users stand for tracks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuework.functions import predicates as pr
from cuework.functions import text as tx
from cuework.operators import aggregates as agg
from cuework.operators import joins as jn
from cuework.operators import windows as win
from cuework.plans.scenes import vocal_bounds
from cuework.plans.segments import select_segments
from cuework.queries.registry import DAY, HOUR, E, of_type, query, r

USER = ["user_id"]
TYPES = ["click", "error", "purchase", "signup", "view"]
SESSION_SQL = f"""
WITH {E}, g AS (SELECT *, lag(t) OVER w AS p FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > 43200 THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY t) AS isl FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, isl ORDER BY t) - 1 AS n FROM i),
s AS (SELECT *, n % 8 AS in_group,
        dense_rank() OVER (PARTITION BY user_id ORDER BY isl, n // 8) - 1 AS group_index FROM k)"""


def sessions(t):
    return win.group_by_pause(t("events").select("event_id", "user_id", "t", "value"), USER, "t", "t",
                              gap=12 * HOUR, max_items=8)


@query("session_summary_top3", SESSION_SQL + """,
a AS (SELECT user_id, group_index, min(t) AS start_s, max(t) AS end_s, count(*) AS items,
        sum(value) AS total FROM s GROUP BY ALL),
k2 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY items DESC, start_s) AS rank FROM a)
SELECT user_id, CAST(group_index AS BIGINT) AS group_index, round(start_s, 3) AS start_s,
  round(end_s, 3) AS end_s, items, round(total, 4) AS total, CAST(rank AS INTEGER) AS rank
FROM k2 WHERE rank <= 3""")
def session_summary_top3(t):
    """Flagship: pause groups, summed up, best three per user."""
    from cuework.operators.ranking import top_n
    a = sessions(t).groupBy("user_id", "group_index").agg(
        F.min("t").alias("s"), F.max("t").alias("e"), F.count(F.lit(1)).alias("items"),
        F.sum("value").alias("v"))
    top = top_n(a, USER, [F.col("items").desc(), F.col("s").asc()], 3)
    return top.select("user_id", "group_index", r("s", 3).alias("start_s"), r("e", 3).alias("end_s"),
                      "items", r("v", 4).alias("total"), "rank")


@query("w1_line_ends", f"""WITH {E} SELECT event_id, round(greatest(t + 1800, least(coalesce(
  lead(t) OVER (PARTITION BY user_id ORDER BY t), t + 28800), t + 28800)) - t, 3) AS hold FROM e""")
def w1(t):
    out = win.infer_line_ends(t("events").select("event_id", "user_id", "t"), USER, "t",
                              max_hold=8 * HOUR, min_len=HOUR / 2)
    return out.select("event_id", r(F.col("end") - F.col("t"), 3).alias("hold"))


FRAMES_SQL = f"""{E}, f AS (SELECT user_id, CAST(floor(t / 21600) AS BIGINT) AS frame,
  sum(value) AS energy FROM e GROUP BY ALL)"""


def frames(t, hop=6 * HOUR):
    return t("events").groupBy("user_id", F.floor(F.col("t") / hop).alias("frame")).agg(
        F.sum("value").alias("energy"))


@query("w2_active_regions", f"""WITH {FRAMES_SQL},
p AS (SELECT *, max(energy) OVER (PARTITION BY user_id) AS peak FROM f),
l AS (SELECT *, lag(frame) OVER (PARTITION BY user_id ORDER BY frame) AS prev FROM p
      WHERE energy > peak * 0.12),
i AS (SELECT *, sum(CASE WHEN prev IS NULL OR frame * 6.0 - (prev + 1) * 6.0 > 6 THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY frame) AS isl FROM l)
SELECT user_id, min(frame) * 6.0::DOUBLE AS start_h, (max(frame) + 1) * 6.0::DOUBLE AS end_h FROM i
GROUP BY user_id, isl HAVING (max(frame) + 1) * 6.0 - min(frame) * 6.0 >= 12""")
def w2(t):
    out = win.active_regions(frames(t), USER, hop=6.0, merge_gap=6.0, min_len=12.0)
    return out.select("user_id", F.col("start").alias("start_h"), F.col("end").alias("end_h"))


@query("w3_pause_groups", SESSION_SQL + """ SELECT event_id, CAST(group_index AS BIGINT) AS group_index,
  CAST(in_group AS BIGINT) AS in_group FROM s""")
def w3(t):
    return sessions(t).select("event_id", "group_index", F.col("in_group").cast("long").alias("in_group"))


@query("w4_gap_interpolation", f"""WITH {E},
o AS (SELECT user_id, event_id, CASE WHEN event_id % 3 <> 0 THEN t END AS s,
  CASE WHEN event_id % 3 <> 0 THEN t + 60 END AS en, value / 500 AS c,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM e),
b AS (SELECT *, max(CASE WHEN s IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS li,
  min(CASE WHEN s IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ri FROM o),
j AS (SELECT b.*, l.en AS t0, CASE WHEN q.s <= l.en THEN l.en + 0.08 * (b.ri - b.li - 1) ELSE q.s END
    AS t1 FROM b LEFT JOIN o l ON l.user_id = b.user_id AND l.i = b.li
  LEFT JOIN o q ON q.user_id = b.user_id AND q.i = b.ri),
k AS (SELECT *, (t1 - t0) / (ri - li - 1) AS step, i - li - 1 AS k FROM j)
SELECT event_id, s IS NOT NULL AS matched,
  round(CASE WHEN s IS NULL THEN t0 + k * step ELSE s END, 3) AS start_s,
  round(CASE WHEN s IS NULL THEN greatest(CASE WHEN t0 IS NULL OR step IS NULL THEN NULL
    ELSE t0 + k * step + 0.08 END, t0 + (k + 1) * step) ELSE en END, 3) AS end_s,
  round(CASE WHEN s IS NOT NULL THEN c WHEN t0 IS NULL OR t1 IS NULL THEN 0 ELSE 0.2 END, 6) AS conf
FROM k""")
def w4(t):
    timed = F.col("event_id") % 3 != 0
    df = t("events").select("user_id", "event_id", F.when(timed, F.col("t")).alias("start"),
                            F.when(timed, F.col("t") + 60).alias("end"),
                            (F.col("value") / 500).alias("confidence"))
    return win.interpolate_gaps(df, USER, "event_id").select(
        "event_id", "matched", r("start", 3).alias("start_s"), r("end", 3).alias("end_s"),
        r("confidence").alias("conf"))


@query("w5_clamp_monotonic", """WITH m AS (SELECT *, max(value) OVER (PARTITION BY user_id
  ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events)
SELECT event_id, round(greatest(value, coalesce(m, value)), 3) AS start_v,
  round(greatest(value, coalesce(m, value)) + 1, 3) AS end_v,
  round(greatest(coalesce(m, value) - value, 0), 3) AS shift FROM m""")
def w5(t):
    df = t("events").select("user_id", "event_id", F.col("value").alias("start"),
                            (F.col("value") + 1).alias("end"))
    return win.clamp_monotonic(df, USER, ["event_id"]).select(
        "event_id", r("start", 3).alias("start_v"), r("end", 3).alias("end_v"),
        r("shift", 3).alias("shift"))


@query("w6_is_monotonic", """WITH m AS (SELECT user_id, value < lag(value) OVER (PARTITION BY user_id
  ORDER BY event_id) - 0.05 AS bad FROM events)
SELECT user_id, NOT bool_or(coalesce(bad, false)) AS monotonic, count(*) FILTER (bad) AS backward_jumps
FROM m GROUP BY user_id""")
def w6(t):
    return win.is_monotonic(t("events"), USER, ["event_id"], "value")


def week_lines(t):
    e = t("events")
    wk = F.floor(F.col("t") / (7 * DAY))
    lines = e.select("user_id", wk.alias("week"), F.col("event_id").alias("line_index"),
                     F.col("t").alias("start"), (F.col("t") + F.col("value") * 60).alias("end"))
    segs = lines.select("user_id", "week").distinct().select(
        "user_id", "week", (F.col("week") * 7 * DAY).alias("segment_start"),
        ((F.col("week") + 1) * 7 * DAY).alias("segment_end"))
    return lines, segs


@query("w7_w8_carve_spans", f"""WITH {E},
l AS (SELECT user_id, CAST(floor(t / 604800) AS BIGINT) AS week, event_id, t AS s, t + value * 60 AS en FROM e),
x AS (SELECT *, week * 604800.0::DOUBLE AS lo, (week + 1) * 604800.0::DOUBLE AS hi,
  row_number() OVER (PARTITION BY user_id, week ORDER BY s, event_id) AS i FROM l
  WHERE en > week * 604800 AND s < (week + 1) * 604800),
a AS (SELECT *, CASE WHEN i = 1 AND greatest(lo, s) - lo < 10800 THEN lo ELSE greatest(lo, s) END AS a FROM x),
b AS (SELECT *, greatest(least(hi, en), a + 0.5) AS b FROM a),
c AS (SELECT *, coalesce(lag(b) OVER w, lo) AS cur, lead(a) OVER w AS nxt FROM b
  WINDOW w AS (PARTITION BY user_id, week ORDER BY i)),
spans AS (SELECT user_id, week, a AS s, CASE WHEN nxt IS NULL THEN CASE WHEN hi - b >= 10800 THEN b ELSE hi END
    WHEN nxt - b > 0 AND nxt - b < 10800 THEN nxt ELSE b END AS en, event_id AS line_index FROM c),
amb AS (SELECT user_id, week, cur AS s, a AS en FROM c WHERE a - cur >= 10800
  UNION ALL SELECT user_id, week, b, hi FROM c WHERE nxt IS NULL AND hi - b >= 10800),
parts AS (SELECT *, greatest(1, CAST(round_even((en - s) / 21600 + 0.4, 0) AS INTEGER)) AS n FROM amb),
cut AS (SELECT *, unnest(range(n)) AS part FROM parts)
SELECT user_id, week, round(s, 3) AS start_s, round(en, 3) AS end_s, line_index, 0 AS part FROM spans
UNION ALL SELECT user_id, week, round(s + part * ((en - s) / n), 3), round(s + (part + 1) * ((en - s) / n), 3),
  NULL, CAST(part AS INTEGER) FROM cut""")
def w7(t):
    lines, segs = week_lines(t)
    out = win.carve_spans(lines, segs, ["user_id", "week"], min_gap=3 * HOUR, longest=6 * HOUR)
    return out.select("user_id", "week", r("span_start", 3).alias("start_s"),
                      r("span_end", 3).alias("end_s"), "line_index", "part")


DRIFT_SQL = """d AS (SELECT user_id, median(value) AS med, count(*) AS n FROM events GROUP BY 1),
m AS (SELECT user_id, median(abs(value - med)) AS mad FROM events JOIN d USING (user_id) GROUP BY 1),
s AS (SELECT user_id, med, mad, n, CAST(greatest(2, floor(0.25 * n)) AS BIGINT) AS need,
  CASE WHEN n < greatest(2, floor(0.25 * n)) THEN 'too few drifts' WHEN mad > 30 THEN 'drifts disagree'
  END AS rejected FROM d JOIN m USING (user_id))"""


def drift(t):
    df = t("events").select("event_id", "user_id", F.col("value").alias("drift"))
    return df, agg.robust_drift(df, USER, max_mad=30.0)


@query("a6_robust_drift", f"""WITH {DRIFT_SQL} SELECT user_id, round(med, 6) AS drift_median,
  round(mad, 6) AS mad, n AS n_drifts, need, rejected FROM s""")
def a6(t):
    return drift(t)[1].select("user_id", r("drift_median").alias("drift_median"), r("mad").alias("mad"),
                              "n_drifts", "need", "rejected")


@query("w9_reject_drift", f"""WITH {DRIFT_SQL}, o AS (SELECT event_id, user_id, abs(value - med) > 30.004 AS outlier,
  need, rejected FROM events JOIN s USING (user_id)),
k AS (SELECT user_id, count(*) FILTER (NOT outlier) AS kept FROM o GROUP BY 1)
SELECT event_id, outlier, kept, rejected IS NOT NULL OR kept < need AS fall_back FROM o JOIN k USING (user_id)""")
def w9(t):
    df, stats = drift(t)
    return agg.reject_drift(df, stats, USER, tol=30.004).select("event_id", "outlier", "kept", "fall_back")


@query("w10_word_times", """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'),
  lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w)
SELECT doc_id, md5(string_agg(word, ' ' ORDER BY i)) AS words, count(*) AS n,
  round(sum(i * 0.25)::DOUBLE, 3) AS start_sum, round(sum((i + 1) * 0.25)::DOUBLE, 3) AS end_sum FROM u GROUP BY 1""")
def w10(t):
    from cuework.operators.align import word_times
    from cuework.queries.texts import with_words
    ws = tx.words_of("text")
    none = F.lit(None).cast("array<struct<text:string,start:double>>")
    d = with_words(t).withColumn("w", word_times(ws, none, F.lit(0.0), F.size(ws) * 0.25, F.lit(0.6)))
    add = lambda f: F.aggregate(f"w", F.lit(0.0), lambda a, x: a + x[f])
    return d.select(
        "doc_id", F.md5(F.array_join(F.transform("w", lambda x: x["text"]), " ")).alias("words"),
        F.size("w").cast("long").alias("n"), r(add("start"), 3).alias("start_sum"),
        r(add("end"), 3).alias("end_sum"))


@query("w11_thin_events", f"""WITH RECURSIVE {E},
o AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM e),
k AS (SELECT user_id, t, i FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, min(o.t), min(o.i) FROM k JOIN o ON o.user_id = k.user_id
    AND o.t - k.t >= 43200 GROUP BY o.user_id, k.i)
SELECT user_id, round(t, 6) AS kept_s FROM k""")
def w11(t):
    out = win.thin_events(t("events").select("user_id", "t"), USER, "t", gap=12 * HOUR)
    return out.select("user_id", r("t").alias("kept_s"))


@query("w12_ordinal", """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx
FROM events""")
def w12(t):
    return win.ordinal(t("events").select("event_id", "user_id"), USER, ["event_id"]).select(
        "event_id", "idx")


@query("w13_vocal_bounds", f"""WITH {E},
s AS (SELECT user_id, event_id AS sc, t AS a, t + 86400 AS b FROM e WHERE event_type = 'purchase'),
w AS (SELECT user_id, event_id - 1 AS li, min(t + 600) AS ws, max(t + 3000) AS we FROM e GROUP BY ALL),
g AS (SELECT user_id, t AS rs, t + 7200 AS re FROM e WHERE event_type = 'view'),
o AS (SELECT s.user_id, sc, min(greatest(a, rs)) AS lo, max(least(b, re)) AS hi FROM s JOIN g ON
  s.user_id = g.user_id AND least(b, re) - greatest(a, rs) >= 1800 GROUP BY ALL),
kn AS (SELECT DISTINCT user_id FROM g)
SELECT s.sc AS scene, round(coalesce(o.lo, greatest(a, coalesce(ws, a))), 3) AS vocal_start,
  round(coalesce(o.hi, least(b, coalesce(we, b))), 3) AS vocal_end,
  kn.user_id IS NOT NULL AND o.lo IS NULL AS no_vocal
FROM s LEFT JOIN w ON w.user_id = s.user_id AND w.li = s.sc LEFT JOIN o ON o.sc = s.sc
LEFT JOIN kn ON kn.user_id = s.user_id""")
def w13(t):
    e = t("events")
    scenes = of_type(e, "purchase").select(
        "user_id", F.col("event_id").alias("scene_index"), F.col("event_id").alias("line_index"),
        F.col("t").alias("start"), (F.col("t") + DAY).alias("end"), F.lit("x").alias("lyric"))
    words = e.select("user_id", (F.col("event_id") - 1).alias("line_index"),
                     (F.col("t") + 600).alias("start"), (F.col("t") + 3000).alias("end"))
    regions = of_type(e, "view").select("user_id", F.col("t").alias("start"),
                                        (F.col("t") + 7200).alias("end"))
    out = vocal_bounds(scenes, words, regions, USER, min_overlap=1800.0, base=HOUR)
    return out.select(F.col("scene_index").alias("scene"), r("vocal_start", 3).alias("vocal_start"),
                      r("vocal_end", 3).alias("vocal_end"), "no_vocal")


# --- aggregates -------------------------------------------------------------------------------------

@query("a1_line_summary", f"""WITH {E}, w AS (SELECT user_id, CASE WHEN event_id % 3 <> 0 THEN t END AS s,
  t + 60 AS en, CASE WHEN event_id % 7 <> 0 THEN value END AS c FROM e)
SELECT user_id, round(min(s), 3) AS start_s, round(max(CASE WHEN s IS NOT NULL THEN en END), 3) AS end_s,
  round_even(CASE WHEN count(s) > 0 THEN avg(coalesce(c, 0)) ELSE 0 END, 3) AS confidence FROM w GROUP BY 1""")
def a1(t):
    w = t("events").select("user_id", F.when(F.col("event_id") % 3 != 0, F.col("t")).alias("start"),
                           (F.col("t") + 60).alias("end"),
                           F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("confidence"))
    return agg.line_summary(w, USER).select("user_id", r("start", 3).alias("start_s"),
                                            r("end", 3).alias("end_s"), "confidence")


@query("a2_match_stats", """SELECT user_id, round_even(avg((event_type = 'purchase')::INT), 4) AS matched_ratio,
  round_even(avg(value), 4) AS mean_confidence FROM events GROUP BY 1""")
def a2(t):
    w = t("events").select("user_id", (F.col("event_type") == "purchase").alias("matched"),
                           F.col("value").alias("confidence"))
    return agg.match_stats(w, USER)


TOTALS_SQL = "SELECT user_id, " + ", ".join(
    f"sum(CASE WHEN event_type = '{n}' THEN value ELSE 0 END) AS \"{n}\"" for n in TYPES) + \
    " FROM events GROUP BY 1"


def type_totals(t):
    return agg.emotion_totals(t("events"), USER, "event_type", "value", TYPES)


@query("a3_category_totals", "SELECT user_id, " + ", ".join(f'round("{n}", 4) AS "{n}"' for n in TYPES)
       + f" FROM ({TOTALS_SQL})")
def a3(t):
    return type_totals(t).select("user_id", *[r(n, 4).alias(n) for n in TYPES])


@query("a4_recommend_style", f"""WITH x AS ({TOTALS_SQL}), y AS (SELECT user_id, click + error + 0.5 * "view" AS a,
  purchase + signup + 0.5 * "view" AS b FROM x)
SELECT user_id, CASE WHEN a + b > 0 AND b > a * 1.15 THEN 'B' ELSE 'A' END AS recommended_style,
  CASE WHEN a + b <= 0 THEN 0 ELSE round_even(CASE WHEN b > a * 1.15 THEN b ELSE a END / (a + b), 3) END
  AS recommendation_confidence FROM y""")
def a4(t):
    out = agg.recommend_style(type_totals(t), {"click": 1, "error": 1, "view": .5},
                              {"purchase": 1, "signup": 1, "view": .5}, ("A", "B"))
    return out.select("user_id", "recommended_style", "recommendation_confidence")


@query("a5_rms_envelope", f"""WITH {E}, f AS (SELECT user_id, CAST(floor(t / 21600) AS BIGINT) AS frame,
  sqrt(avg(value * value)) AS rms FROM e GROUP BY ALL)
SELECT user_id, frame, round(rms, 6) AS rms, round(rms / max(rms) OVER (PARTITION BY user_id), 6) AS energy FROM f""")
def a5(t):
    return agg.rms_envelope(t("events"), USER, hop=6 * HOUR).select(
        "user_id", "frame", r("rms").alias("rms"), r("energy").alias("energy"))


OFFSET_SQL = f"""{FRAMES_SQL}, n AS (SELECT user_id, max(energy) AS peak, max(frame) + 1 AS nf FROM f GROUP BY 1),
v AS (SELECT f.user_id, frame, (energy > peak * 0.15)::INT AS loud FROM f JOIN n USING (user_id)),
sp AS (SELECT user_id, t AS s, t + 43200 AS en FROM e WHERE event_type = 'purchase'),
k AS (SELECT unnest(range(-8, 9)) AS k),
x AS (SELECT sp.user_id, k, greatest(0, least(nf, CAST(round_even((s + k * 21600) / 21600, 0) AS BIGINT))) AS a,
  greatest(0, least(nf, CAST(round_even((en + k * 21600) / 21600, 0) AS BIGINT))) AS b
  FROM sp JOIN n USING (user_id), k),
act AS (SELECT DISTINCT user_id, k, unnest(range(a, b)) AS frame FROM x WHERE b > a),
sc AS (SELECT act.user_id, k, sum(coalesce(loud, 0)) / count(*) AS score FROM act LEFT JOIN v ON v.user_id = act.user_id
  AND v.frame = act.frame GROUP BY ALL),
z AS (SELECT user_id, max(CASE WHEN k = 0 THEN score END) AS zero FROM sc GROUP BY 1),
bst AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, k) AS rn FROM sc),
res AS (SELECT u.user_id, CASE WHEN score > coalesce(zero, 0) THEN k * 21600.0 ELSE 0 END AS off,
  CASE WHEN score > coalesce(zero, 0) THEN score ELSE coalesce(zero, 0) END AS best, coalesce(zero, 0) AS zero
  FROM (SELECT DISTINCT user_id FROM sp) u LEFT JOIN z USING (user_id)
  LEFT JOIN (SELECT * FROM bst WHERE rn = 1) USING (user_id))"""


def offsets(t):
    spans = of_type(t("events"), "purchase").select(
        "user_id", "event_id", F.col("t").alias("start"), (F.col("t") + 12 * HOUR).alias("end"))
    return spans, agg.estimate_offset(spans, frames(t), USER, hop=6 * HOUR, search=48 * HOUR,
                                      step=6 * HOUR)


@query("a7_offset_search", f"""WITH {OFFSET_SQL} SELECT user_id, off::DOUBLE AS offset_s,
  round_even(best, 3)::DOUBLE AS best_score, round_even(zero, 3)::DOUBLE AS zero_score FROM res""")
def a7(t):
    return offsets(t)[1].select("user_id", r("offset").alias("offset_s"), "best_score", "zero_score")


@query("a8_apply_offset", f"""WITH {OFFSET_SQL}, q AS (SELECT user_id, CASE WHEN abs(off) >= 0.3
  AND round_even(best, 3) >= 0.55 AND round_even(best, 3) - round_even(zero, 3) >= 0.1 THEN off ELSE 0 END AS ap FROM res)
SELECT event_id, round(t + ap, 3) AS start_s FROM e JOIN q USING (user_id) WHERE event_type = 'purchase'""")
def a8(t):
    spans, off = offsets(t)
    out = agg.apply_offset(spans, agg.accept_offset(off), USER)
    return out.select("event_id", r("start", 3).alias("start_s"))


@query("a9_plan_summary", """SELECT user_id, count(*) AS scene_count, count(*) FILTER (event_type <> 'view')
  AS lyric_scene_count FROM events GROUP BY 1""")
def a9(t):
    return agg.plan_summary(t("events").withColumn("lyric", F.nullif("event_type", F.lit("view"))), USER)


@query("a10_ordered_distinct", """WITH m AS (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_at) - 1 AS rank FROM m""")
def a10(t):
    return agg.ordered_distinct(t("events"), USER, "event_type", "event_id")


@query("a11_dedupe_first", """SELECT user_id, event_type, event_id, round(value, 4) AS value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""")
def a11(t):
    df = t("events").select("user_id", "event_type", "event_id", r("value", 4).alias("value"))
    return agg.dedupe_first(df, ["user_id", "event_type"], ["event_id"])


@query("a12_quality_counts", """SELECT user_id, count(*) FILTER (event_id % 7 <> 0 AND value / 100 < 0.55) AS
  uncertain_lines, count(*) FILTER (event_type = 'view') AS untranslated_lines FROM events GROUP BY 1""")
def a12(t):
    df = t("events").select("user_id", F.when(F.col("event_id") % 7 != 0, F.col("value") / 100)
                            .alias("confidence"), F.nullif("event_type", F.lit("view")).alias("translation"))
    return agg.quality_counts(df, USER)


@query("a13_cleanup_totals", """SELECT count(*) AS items, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS bytes_freed
FROM documents WHERE n_chars > 5000""")
def a13(t):
    return agg.cleanup_totals(t("documents").filter("n_chars > 5000"), "n_chars")


@query("a14_beat_period", """SELECT event_id, round(greatest(0.45, least(1.4, 60 / greatest(40, value))), 6) AS
  beat FROM events""")
def a14(t):
    return t("events").select("event_id", r(agg.beat_period(F.col("value"))).alias("beat"))


@query("a15_onset_density", f"""WITH {E}, w AS (SELECT DISTINCT user_id, floor(t / 86400) * 86400.0 AS s FROM e
  WHERE event_type = 'purchase'), c AS (SELECT user_id, t FROM e WHERE event_type = 'click'),
n AS (SELECT w.user_id, s, count(c.t) AS n FROM w LEFT JOIN c ON c.user_id = w.user_id AND c.t >= s
  AND c.t < s + 86400 GROUP BY ALL)
SELECT user_id, round(s, 1)::DOUBLE AS start_s, n, round(CASE WHEN max(n) OVER (PARTITION BY user_id) > 0 THEN
  (n / 86400) / (max(n) OVER (PARTITION BY user_id) / 86400) ELSE 0 END, 6)::DOUBLE AS relative_density FROM n""")
def a15(t):
    e = t("events")
    w = of_type(e, "purchase").select("user_id", (F.floor(F.col("t") / DAY) * DAY).alias("start"),
                                      F.lit(DAY).alias("length")).distinct()
    out = agg.onset_density(of_type(e, "click").select("user_id", "t"), w, USER)
    return out.select("user_id", r("start", 1).alias("start_s"), "n",
                      r("relative_density").alias("relative_density"))


# --- time joins ------------------------------------------------------------------------------------------

@query("j4_nearest_join", f"""WITH {E}, p AS (SELECT * FROM e WHERE event_type = 'purchase'),
c AS (SELECT user_id, t AS ct FROM e WHERE event_type = 'click'),
x AS (SELECT event_id, t, ct, row_number() OVER (PARTITION BY event_id ORDER BY abs(ct - t), ct) AS rn
  FROM p LEFT JOIN c USING (user_id))
SELECT event_id, round(CASE WHEN abs(ct - t) <= 21600 THEN ct END, 3) AS nearest_s FROM x WHERE rn = 1""")
def j4(t):
    e = t("events")
    out = jn.nearest_join(of_type(e, "purchase").select("event_id", "user_id", "t"),
                          of_type(e, "click").select("user_id", "t"), USER, tol=6 * HOUR)
    return out.select("event_id", r("nearest.t", 3).alias("nearest_s"))


def purchases(t):
    return of_type(t("events"), "purchase").select(
        "user_id", F.col("event_id").alias("span_id"), F.col("t").alias("start"),
        (F.col("t") + DAY).alias("end"))


@query("j5_overlap_join", f"""WITH {E}, p AS (SELECT user_id, event_id, t AS a, t + 86400 AS b FROM e
  WHERE event_type = 'purchase'), g AS (SELECT user_id, t AS rs, t + value * 600 AS re FROM e WHERE event_type = 'view')
SELECT event_id AS span_id, round(min(CASE WHEN least(b, re) - greatest(a, rs) >= 1800 THEN greatest(a, rs) END), 3)
  AS lo_s, round(max(CASE WHEN least(b, re) - greatest(a, rs) >= 1800 THEN least(b, re) END), 3) AS hi_s
FROM p LEFT JOIN g USING (user_id) GROUP BY 1""")
def j5(t):
    regions = of_type(t("events"), "view").select("user_id", F.col("t").alias("start"), (
        F.col("t") + F.col("value") * 600).alias("end"))
    out = jn.overlap_join(purchases(t), regions, USER, ["span_id"], 1800.0, base=HOUR)
    return out.select("span_id", r("overlap_start", 3).alias("lo_s"), r("overlap_end", 3).alias("hi_s"))


@query("j6_points_in_spans", f"""WITH {E}, p AS (SELECT user_id, event_id, t AS a FROM e WHERE event_type = 'purchase')
SELECT p.event_id AS span_id, round_even(t - a, 3) AS rel FROM p JOIN e ON e.user_id = p.user_id
  AND e.event_type = 'click' AND t >= a AND t < a + 86400""")
def j6(t):
    return jn.relative_points(of_type(t("events"), "click"), purchases(t), USER, ["span_id"],
                              base=HOUR).select("span_id", "rel")


@query("j7_mean_energy", f"""WITH {FRAMES_SQL}, p AS (SELECT user_id, event_id, CAST(floor(t / 21600) AS BIGINT) AS i0,
  CAST(greatest(floor(t / 21600) + 1, floor((t + 86400) / 21600)) AS BIGINT) AS i1 FROM e WHERE event_type = 'purchase')
SELECT event_id AS span_id, round(coalesce(avg(energy), 0.5), 5) AS mean_energy FROM p LEFT JOIN f ON
  f.user_id = p.user_id AND frame >= i0 AND frame < i1 GROUP BY 1""")
def j7(t):
    return jn.mean_energy(frames(t), purchases(t), USER, ["span_id"], hop=6 * HOUR).select(
        "span_id", r("mean_energy", 5).alias("mean_energy"))


@query("j17_sample_timeline", f"""WITH {E}, p AS (SELECT user_id, event_id, t AS a, least(coalesce(lead(t) OVER
    (PARTITION BY user_id ORDER BY t), t + 86400), t + 172800) AS b FROM e WHERE event_type = 'purchase'),
l AS (SELECT user_id, max(b) AS stop, max(event_id) AS last FROM p GROUP BY 1),
s AS (SELECT user_id, last, unnest(range(greatest(1, CAST(ceil(stop / 21600) AS INTEGER)))) AS sample FROM l),
x AS (SELECT s.user_id, sample, last, p.event_id, p.a FROM s LEFT JOIN p ON p.user_id = s.user_id
  AND sample * 21600 >= a AND sample * 21600 < b)
SELECT x.user_id, sample, coalesce(x.event_id, last) AS span_index, CAST(count(c.t) % 3 AS INTEGER) AS variant
FROM x LEFT JOIN e c ON c.user_id = x.user_id AND c.event_type = 'click' AND c.t >= x.a AND c.t <= sample * 21600
GROUP BY ALL""")
def j17(t):
    e = t("events")
    # spans end at the next purchase, two days on at the latest
    spans = win.infer_line_ends(of_type(e, "purchase").select("user_id", "event_id", "t"), USER, "t",
                                max_hold=2 * DAY, min_len=0.0)
    last = spans.groupBy("user_id").agg(F.max("t").alias("_m"))
    spans = spans.join(last, USER).select(
        "user_id", F.col("event_id").alias("span_index"), F.col("t").alias("start"),
        F.when(F.col("t") == F.col("_m"), F.col("t") + DAY).otherwise(F.col("end")).alias("end"))
    out = jn.sample_timeline(spans, of_type(e, "click").select("user_id", "t"), USER, 6 * HOUR, 3)
    return out.select("user_id", F.col("sample").cast("long").alias("sample"), "span_index", "variant")


# --- predicates over time ----------------------------------------------------------------------------------

@query("f5_confidence_flags", """SELECT user_id, avg(value) / 100 < 0.35 AS suspect,
  count(*) FILTER (value / 100 < 0.55) AS uncertain_rows FROM events GROUP BY 1""")
def f5(t):
    return t("events").groupBy("user_id").agg(
        pr.suspect(F.avg("value") / 100).alias("suspect"),
        F.count_if(pr.uncertain(F.col("value") / 100)).alias("uncertain_rows"))


@query("f6_clip_to_segment", f"""WITH {E}, l AS (SELECT event_id, floor(t / 604800) * 604800.0 + 172800 AS lo,
  floor(t / 604800) * 604800.0 + 432000 AS hi, t AS s, t + value * 60 AS en FROM e)
SELECT event_id, round(greatest(0, s - lo), 3) AS start_s, round(least(hi - lo, en - lo), 3) AS end_s FROM l
WHERE en > lo AND s < hi""")
def f6(t):
    lines, segs = week_lines(t)
    segs = segs.withColumns({"segment_start": F.col("segment_start") + 2 * DAY,
                             "segment_end": F.col("segment_start") + 5 * DAY})
    out = pr.clip_to_segment(lines, segs, ["user_id", "week"])
    return out.select(F.col("line_index").alias("event_id"), r("start", 3).alias("start_s"),
                      r("end", 3).alias("end_s"))


@query("f7_shift_and_clamp", f"""WITH {E}, o AS (SELECT event_id, t AS s, t + 600 AS en, (user_id % 3 - 1) * 3600.0 AS off,
  2592000.0 AS dur, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS j FROM e),
x AS (SELECT *, greatest(0, least(dur, s + off)) AS s0 FROM o)
SELECT event_id, round(CASE WHEN off = 0 THEN s WHEN i = 1 THEN 0 ELSE s0 END, 3) AS start_s,
  round(CASE WHEN off = 0 THEN en WHEN j = 1 THEN dur ELSE greatest(s0 + 0.1, least(dur, en + off)) END, 3) AS end_s
FROM x""")
def f7(t):
    df = t("events").select("user_id", "event_id", F.col("t").alias("start"), (F.col("t") + 600).alias("end"),
                            ((F.col("user_id") % 3 - 1) * HOUR).alias("off"), F.lit(30 * DAY).alias("dur"))
    out = pr.shift_and_clamp(df, USER, "off", "dur", "event_id")
    return out.select("event_id", r("start", 3).alias("start_s"), r("end", 3).alias("end_s"))


@query("f8_energy_band", """SELECT event_id, CASE WHEN value / 100 < 0.4 THEN 'calm' WHEN value / 100 < 0.7
  THEN 'normal' ELSE 'energetic' END AS band FROM events""")
def f8(t):
    return t("events").select("event_id", pr.energy_band(F.col("value") / 100).alias("band"))


@query("f11_visibility", f"""WITH {E} SELECT event_id, round(CASE WHEN event_type <> 'view' THEN greatest(t, t + value - 20)
  END, 6) AS show_at, round(CASE WHEN event_type <> 'view' THEN CASE WHEN event_id % 5 = 0 THEN t + 60 ELSE
  least(t + 60, t + value + 1) END END, 6) AS hide_at FROM e""")
def f11(t):
    c = F.col("t")
    v = pr.visibility(c, c + 60, c + F.col("value") - 20,
                      F.when(F.col("event_id") % 5 != 0, c + F.col("value")),
                      F.col("event_type") == "view")
    return t("events").select("event_id", r(v["show_at"], 6).alias("show_at"),
                              r(v["hide_at"], 6).alias("hide_at"))


@query("f14_media_preference", """SELECT event_id, CASE WHEN event_type = 'view' AND value / 100 >= 0.7 THEN 'video'
  ELSE 'photo' END AS preference FROM events""")
def f14(t):
    style = F.when(F.col("event_type") == "view", "doodleMemory").otherwise("archiveCollage")
    return t("events").select("event_id", pr.media_preference(
        style, pr.energy_band(F.col("value") / 100)).alias("preference"))


# --- segment selection ----------------------------------------------------------------------------------

@query("d1_select_segments", f"""WITH {FRAMES_SQL}, pk AS (SELECT user_id, max(energy) AS peak FROM f GROUP BY 1),
fr AS (SELECT user_id, frame, energy / peak AS en FROM f JOIN pk USING (user_id)),
tr AS (SELECT user_id, max(t) AS dur, max(t) - 259200 AS lim FROM e GROUP BY 1),
bt AS (SELECT user_id, t FROM e WHERE event_type = 'click'), ons AS (SELECT user_id, t FROM e WHERE event_type = 'view'),
sec AS (SELECT user_id, t, value AS rep FROM e WHERE event_type = 'purchase'),
cand AS (SELECT user_id, lim, round_even(i * 43200.0, 2) AS c FROM (SELECT user_id, lim,
    unnest(range(CAST(floor(lim / 43200) AS INTEGER) + 1)) AS i FROM tr WHERE lim > 0)
  UNION SELECT user_id, lim, round_even(t, 2) FROM sec JOIN tr USING (user_id) WHERE lim > 0 AND t <= lim),
dens AS (SELECT cand.user_id, c, count(ons.t) AS n FROM cand LEFT JOIN ons ON ons.user_id = cand.user_id AND ons.t >= c
  AND ons.t < c + 259200 GROUP BY ALL), dm AS (SELECT user_id, max(n) / 259200 AS dmax FROM dens GROUP BY 1),
nb AS (SELECT cand.user_id, c, lim, arg_min(bt.t, (abs(bt.t - c), bt.t)) AS b FROM cand LEFT JOIN bt USING (user_id) GROUP BY ALL),
st AS (SELECT user_id, c, CASE WHEN abs(b - c) <= 10800 AND b <= lim THEN b ELSE c END AS s FROM nb),
od AS (SELECT st.user_id, c, s, count(ons.t) / 259200 AS od FROM st LEFT JOIN ons ON ons.user_id = st.user_id
  AND ons.t >= s AND ons.t < s + 259200 GROUP BY ALL),
me AS (SELECT st.user_id, c, coalesce(sum(en) / count(en), 0) AS me FROM st LEFT JOIN fr ON fr.user_id = st.user_id
  AND frame >= floor(s / 21600) AND frame < floor((s + 259200) / 21600) + 1 GROUP BY ALL),
bs AS (SELECT st.user_id, c, coalesce(greatest(0, 1 - min(abs(sec.t - s)) / 86400), 0) AS bs,
    arg_max(sec.rep, sec.t) FILTER (sec.t <= s) AS rep FROM st LEFT JOIN sec USING (user_id) GROUP BY ALL),
rp AS (SELECT user_id, arg_min(rep, t) AS first, max(rep) AS rmax FROM sec GROUP BY 1),
sc AS (SELECT od.user_id, od.c, od.s, 0.40 * me + 0.25 * (od / CASE WHEN dmax = 0 THEN 1 ELSE dmax END) + 0.20 * bs
    + 0.15 * coalesce(coalesce(rep, first) / CASE WHEN rmax = 0 THEN 1 ELSE rmax END, 0) AS score
  FROM od JOIN me ON me.user_id = od.user_id AND me.c = od.c JOIN bs ON bs.user_id = od.user_id AND bs.c = od.c
  LEFT JOIN rp ON rp.user_id = od.user_id LEFT JOIN dm ON dm.user_id = od.user_id),
best AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, c) AS rn FROM sc)
SELECT user_id, round(s, 3) AS start_s, round(s + 259200, 3) AS end_s, round(score, 5) AS score, 'scored' AS mode
FROM best WHERE rn = 1
UNION ALL SELECT user_id, 0, round(dur, 3), 1, 'whole' FROM tr WHERE lim <= 0""")
def d1(t):
    e = t("events")
    f = frames(t)
    peak = f.groupBy("user_id").agg(F.max("energy").alias("_p"))
    f = f.join(peak, USER).select("user_id", "frame", (F.col("energy") / F.col("_p")).alias("energy"))
    tracks = e.groupBy("user_id").agg(F.max("t").alias("duration"))
    out = select_segments(
        tracks, f, of_type(e, "click").select("user_id", "t"), of_type(e, "view").select("user_id", "t"),
        of_type(e, "purchase").select("user_id", "t", F.col("value").alias("repetition")), USER,
        target=3 * DAY, hop=6 * HOUR, grid=12 * HOUR, snap=3 * HOUR, boundary=DAY)
    return out.select("user_id", r("start", 3).alias("start_s"), r("end", 3).alias("end_s"),
                      r("score", 5).alias("score"), "mode")
