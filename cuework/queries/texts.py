"""Text functions, predicates and text joins over ``documents``, ``pages``, ``part`` and friends."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuework.functions import fixed_values as fixed
from cuework.functions import hashing as hs
from cuework.functions import predicates as pr
from cuework.functions import text as tx
from cuework.operators import joins as jn
from cuework.operators import ranking as rk
from cuework.queries.registry import of_type, query, quote, r, values

DOC = ["doc_id"]


# --- SQL building blocks ---------------------------------------------------------------------------------

def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_norm_token(x: str) -> str:
    return f"regexp_replace(lower(strip_accents({x})), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"


def sql_title(x: str) -> str:
    t = f"regexp_replace(strip_accents({x}), {quote(fixed.BRACKETED)}, ' ', 'g')"
    t = f"regexp_replace({t}, {quote(fixed.TITLE_NOISE)}, ' ', 'g')"
    t = f"regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def sql_clean(x: str) -> str:
    t = f"regexp_replace({x}, {quote(fixed.BRACKETED)}, ' ', 'g')"
    t = f"regexp_split_to_array({t}, '\\s+[|•·]\\s+')[1]"
    t = f"regexp_replace({t}, {quote(fixed.FEATURING)}, '', 'g')"
    t = f"regexp_replace({t}, {quote(fixed.TRACK_JUNK)}, ' ', 'g')"
    t = f"translate({t}, '“”\"', '')"
    return f"trim(regexp_replace({t}, '\\s{{2,}}', ' ', 'g'), ' -–—•·:|')"


FIRST_SQL = "split_part(text, chr(10), 1)"
LINES_SQL = (f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), "
             "lambda x: x <> '')")
MD5_WORDS = "md5(array_to_string({}, ' '))"


EACH_SQL = ("l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, "
            "CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line FROM documents)")


def each_line(t, *more):
    """All lines of all documents: doc_id, line from 0, x."""
    return t("documents").select("doc_id", *more, F.posexplode(F.split("text", "\n")).alias("line", "x"))


def first():
    """First line of a document."""
    return F.split("text", "\n")[0]


def joined(col):
    return F.md5(F.array_join(col, " "))


# --- scalar functions ----------------------------------------------------------------------------------------

@query("fn1_normalize_token", f"""SELECT doc_id, md5(array_to_string(list_transform({sql_words('text')},
  lambda w: {sql_norm_token('w')}), ' ')) AS norms FROM documents""")
def fn1(t):
    words = tx.normalize_words("text")
    return t("documents").select("doc_id", joined(F.transform(words, lambda w: w["norm"])).alias("norms"))


@query("fn1_normalize_single", f"""WITH w AS (SELECT DISTINCT unnest({sql_words('text')}) AS word FROM documents)
SELECT word, {sql_norm_token('word')} AS norm FROM w""")
def fn1_single(t):
    w = t("documents").select(F.explode(tx.words_of("text")).alias("word")).distinct()
    return w.select("word", tx.normalize_token("word").alias("norm"))


@query("fn1_normalize_token_exact", f"""WITH w AS (SELECT DISTINCT unnest({sql_words('text')}) AS word FROM documents)
SELECT word, {sql_norm_token('word')} AS norm FROM w""")
def fn1_exact(t):
    w = t("documents").select(F.explode(tx.words_of("text")).alias("word")).distinct()
    return w.select("word", tx.normalize_token_exact("word").alias("norm"))


@query("fn2_normalize_title", f"""WITH {EACH_SQL} SELECT doc_id, line, md5({sql_title('x')}) AS title FROM l
UNION ALL SELECT -1 - p_partkey, 0, {sql_title("p_name || ' (Official Video) [HD] ft. ' || p_brand")} FROM part""")
def fn2(t):
    a = each_line(t).select("doc_id", "line", F.md5(tx.normalize_title("x")).alias("title"))
    noisy = F.concat("p_name", F.lit(" (Official Video) [HD] ft. "), "p_brand")
    return a.unionByName(t("part").select((-1 - F.col("p_partkey")).alias("doc_id"), F.lit(0).alias("line"),
                                          tx.normalize_title(noisy).alias("title")))


NOISY_SQL = ("CASE p_partkey % 5 WHEN 0 THEN p_name || ' (Official Video) [4K]' WHEN 1 THEN p_brand || ' - ' || "
             "p_name || ' | Channel' WHEN 2 THEN '\"' || p_name || '\" feat. ' || p_type WHEN 3 THEN p_name || "
             "' Lyric Video HD -' ELSE p_brand || ' – ' || p_name || ' Live' END")


def noisy():
    n, b = F.col("p_name"), F.col("p_brand")
    k = F.col("p_partkey") % 5
    return (F.when(k == 0, F.concat(n, F.lit(" (Official Video) [4K]")))
            .when(k == 1, F.concat(b, F.lit(" - "), n, F.lit(" | Channel")))
            .when(k == 2, F.concat(F.lit('"'), n, F.lit('" feat. '), F.col("p_type")))
            .when(k == 3, F.concat(n, F.lit(" Lyric Video HD -")))
            .otherwise(F.concat(b, F.lit(" – "), n, F.lit(" Live"))))


@query("fn3_clean_track_name", f"SELECT p_partkey, {sql_clean(NOISY_SQL)} AS cleaned FROM part")
def fn3(t):
    return t("part").select("p_partkey", tx.clean_track_name(noisy()).alias("cleaned"))


@query("fn4_split_artist_title", f"""WITH n AS (SELECT p_partkey, p_brand, {NOISY_SQL} AS x FROM part),
c AS (SELECT *, CASE WHEN contains(x, ' - ') THEN instr(x, ' - ') WHEN contains(x, ' – ') THEN instr(x, ' – ')
  ELSE 0 END AS sep FROM n),
g AS (SELECT *, CASE WHEN sep > 0 THEN sep WHEN contains(x, ' | ') THEN instr(x, ' | ') ELSE 0 END AS ga FROM c)
SELECT p_partkey, CASE WHEN sep > 0 THEN trim(left(x, sep - 1)) ELSE '' END AS artist,
  CASE WHEN sep > 0 THEN trim(substr(x, sep + 3)) ELSE trim(x) END AS title,
  CASE WHEN ga > 0 THEN trim(left(x, ga - 1)) ELSE p_brand END AS guess_artist,
  CASE WHEN ga > 0 THEN trim(substr(x, ga + 3)) ELSE trim(x) END AS guess_title FROM g""")
def fn4(t):
    s, g = tx.split_artist_title(noisy()), tx.guess_artist_title(
        noisy(), F.concat("p_brand", F.lit(" - Topic")))
    return t("part").select("p_partkey", s["artist"].alias("artist"), s["title"].alias("title"),
                            g["artist"].alias("guess_artist"), g["title"].alias("guess_title"))


@query("fn5_plain_lines", f"""WITH l AS (SELECT doc_id, {LINES_SQL} AS ls FROM documents)
SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS line_index, unnest(ls) AS text FROM l""")
def fn5(t):
    return tx.plain_lines(t("documents"), DOC, "text")


@query("fn6_tokenize_lines", f"""WITH l AS (SELECT doc_id, {LINES_SQL} AS ls FROM documents),
x AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS line_index, unnest(ls) AS text FROM l),
n AS (SELECT doc_id, line_index, list_filter(list_transform({sql_words('text')}, lambda w: {sql_norm_token('w')}),
  lambda w: w <> '') AS ns FROM x WHERE len(ns) > 0)
SELECT doc_id, line_index, len(ns) AS n, md5(array_to_string(ns, ' ')) AS norms FROM n""")
def fn6(t):
    tok = tx.tokenize_lines(tx.plain_lines(t("documents"), DOC, "text"), DOC)
    return tok.groupBy("doc_id", "line_index").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("word_index", "norm")))
        .alias("w")).select("doc_id", "line_index", "n", joined(F.col("w.norm")).alias("norms"))


@query("fn7_tag_seconds", """SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber * 60 + CAST(l_quantity AS INTEGER)
  + (l_suppkey % 100) / power(10, length(CAST(l_suppkey % 100 AS VARCHAR))) AS seconds FROM lineitem""")
def fn7(t):
    s = lambda c: c.cast("string")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", tx.tag_seconds(
        s(F.col("l_linenumber")), s(F.col("l_quantity").cast("int")), s(F.col("l_suppkey") % 100))
        .alias("seconds"))


TURKISH_SQL = f"""(len(ws) > 0 AND (hits >= greatest(2, length(t) * 0.005) OR
  len(list_filter(ws, lambda w: trim(w, '.,!?''"()') IN ({', '.join(map(quote, fixed.TURKISH_WORDS))}))) / len(ws) >= 0.08))"""
LANG_BASE = f"""b AS (SELECT doc_id, text, lower(text) AS t, length(lower(text)) -
  length(translate(lower(text), '{fixed.TURKISH_CHARS}', '')) AS hits, {sql_words('lower(text)')} AS ws FROM documents)"""


@query("fn8_looks_turkish", f"WITH {LANG_BASE} SELECT doc_id, {TURKISH_SQL} AS turkish FROM b")
def fn8(t):
    return t("documents").select("doc_id", tx.looks_turkish("text").alias("turkish"))


# texts moved into other scripts, so that every branch is reached
SCRIPTS = {1: ("aeionrst", "аеионрст"), 2: ("aeionrst", "αειονρστ"), 3: ("aeionrst", "اهيونرست"),
           4: ("aeionrst", "אהיונרסת")}
MOVED_SQL = "CASE doc_id % 5 " + " ".join(
    f"WHEN {k} THEN translate(text, '{a}', '{b}')" for k, (a, b) in SCRIPTS.items()) + " ELSE text END"


def moved():
    out = F.when(F.lit(False), F.col("text"))
    for k, (a, b) in SCRIPTS.items():
        out = out.when(F.col("doc_id") % 5 == k, F.translate("text", a, b))
    return out.otherwise(F.col("text"))


@query("fn9_guess_language", f"""WITH m AS (SELECT doc_id, {MOVED_SQL} AS text FROM documents),
b AS (SELECT doc_id, text, lower(text) AS t, length(lower(text)) - length(translate(lower(text), '{fixed.TURKISH_CHARS}', ''))
  AS hits, {sql_words('lower(text)')} AS ws, greatest(1, len(regexp_extract_all(text, '\\p{{L}}'))) AS n FROM m)
SELECT doc_id, CASE WHEN len(ws) = 0 THEN NULL WHEN {TURKISH_SQL} THEN 'tr'
  WHEN len(regexp_extract_all(text, '[{fixed.ARABIC}]')) / n > 0.3 THEN 'ar'
  WHEN len(regexp_extract_all(text, '[{fixed.CYRILLIC}]')) / n > 0.3 THEN 'ru'
  WHEN len(regexp_extract_all(text, '[{fixed.GREEK}]')) / n > 0.3 THEN 'el'
  WHEN len(regexp_extract_all(text, '[{fixed.HEBREW}]')) / n > 0.3 THEN 'he' END AS language FROM b""")
def fn9(t):
    return t("documents").select("doc_id", moved().alias("text")).select(
        "doc_id", tx.guess_language("text").alias("language"))


@query("fn10_script_flags", f"""WITH m AS (SELECT doc_id, {MOVED_SQL} AS text FROM documents)
SELECT doc_id, regexp_matches(text, '[{fixed.ARABIC_ALL}]') AS has_arabic, regexp_matches(text, '[{fixed.HEBREW}]') AS has_hebrew,
  regexp_matches(text, '[{fixed.ARABIC_ALL}{fixed.HEBREW}]') AS is_rtl FROM m""")
def fn10(t):
    return t("documents").select("doc_id", tx.script_flags(moved()).alias("f")).select("doc_id", "f.*")


SEM_NORM_SQL = "regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s'']', ' ', 'g')"


@query("fn11_semantic_norm", f"SELECT doc_id, md5({SEM_NORM_SQL}) AS norm FROM documents")
def fn11(t):
    return t("documents").select("doc_id", F.md5(tx.semantic_norm("text")).alias("norm"))


STOP = ", ".join(map(quote, fixed.MEDIA_STOPWORDS))


def sql_token_set(x: str) -> str:
    return (f"list_sort(list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-zğüşıöç]+')), "
            f"lambda w: w NOT IN ({STOP})))")


@query("fn12_token_set", f"""SELECT doc_id, len({sql_token_set('text')}) AS n,
  md5(array_to_string({sql_token_set('text')}, ' ')) AS tokens FROM documents""")
def fn12(t):
    s = tx.token_set("text")
    return t("documents").select("doc_id", F.size(s).cast("long").alias("n"),
                                 joined(F.array_sort(s)).alias("tokens"))


@query("fn13_keyphrases", f"""WITH f AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.,;:\\n]'),
    lambda x: {sql_strip('x')}), lambda x: x <> '')[1:14] AS fs FROM documents),
w AS (SELECT doc_id, list_filter(list_transform(fs, lambda x: list_filter(regexp_extract_all(lower(x), '[a-zA-Z'']+'),
  lambda y: y NOT IN ({', '.join(map(quote, fixed.THEME_STOPWORDS))}))[1:6]), lambda z: len(z) >= 2) AS ws FROM f),
p AS (SELECT doc_id, list_transform(ws, lambda z: array_to_string(z, ' ')) AS ps FROM w),
d AS (SELECT doc_id, list_filter(ps, lambda x, i: list_position(ps, x) = i)[1:10] AS ps FROM p)
SELECT doc_id, len(ps) AS n, array_to_string(ps, '|') AS phrases FROM d""")
def fn13(t):
    k = tx.keyphrases("text")
    return t("documents").select("doc_id", F.size(k).cast("long").alias("n"),
                                 F.array_join(k, "|").alias("phrases"))


@query("fn14_normalize_hashtags", """WITH c AS (SELECT p_partkey, p_brand, list_transform(list_filter([p_name, '#' || p_type,
  '  ', '#'] || string_split(p_name, ' '), lambda x: trim(trim(x), '#') <> ''), lambda x: CASE WHEN
  starts_with(trim(x), '#') THEN trim(x) ELSE '#' || trim(x) END) AS tags FROM part),
m AS (SELECT *, '#' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS mine FROM c)
SELECT p_partkey, array_to_string(CASE WHEN list_contains(list_transform(tags, lambda x: lower(x)), lower(mine)) THEN tags
  ELSE tags[1:1] || [mine] || tags[2:] END, '|') AS tags FROM m""")
def fn14(t):
    tags = F.concat(F.array(F.col("p_name"), F.concat(F.lit("#"), "p_type"), F.lit("  "), F.lit("#")),
                    F.split("p_name", " "))
    return t("part").select("p_partkey", F.array_join(tx.normalize_hashtags(tags, "p_brand"), "|")
                            .alias("tags"))


@query("fn15_caption_template", f"""SELECT p_partkey, left(p_name || ' — ' || p_brand, 90) AS title,
  md5({quote(fixed.CAPTION_LEAD)} || chr(10) || chr(10) || p_name || {quote(fixed.CAPTION_BODY)} || chr(10) || chr(10)
  || '🎵 ' || p_name) AS caption, '#' || replace(p_name, ' ', '') || '|#' || replace(p_brand, '#', '') || '|'
  || {quote('|'.join(fixed.CAPTION_TAGS))} AS hashtags FROM part""")
def fn15(t):
    c = tx.caption_template("p_name", "p_brand")
    return t("part").select("p_partkey", c["title"].alias("title"), F.md5(c["caption"]).alias("caption"),
                            F.array_join(c["hashtags"], "|").alias("hashtags"))


MOODS = [*fixed.EMOTIONS, "neutral"]
STYLES = [*fixed.ART_STYLES, "doodle", "unknown"]


@query("fn16_assemble_prompt", f"""WITH s(style, k, tpl) AS (VALUES {values([(s, 'storybook' if s == 'doodle' else s,
  fixed.ART_STYLES.get('storybook' if s == 'doodle' else s, fixed.ART_STYLES['photo'])) for s in STYLES])}),
m(emotion, pal) AS (VALUES {values(list(fixed.MOOD_PALETTES.items()))}), v AS (SELECT {fixed.VIEWS!r} AS views),
x AS (SELECT p_partkey, p_name, p_type, p_partkey % 4 AS variant, {STYLES!r}[p_partkey % {len(STYLES)} + 1] AS style,
  {MOODS!r}[p_partkey % {len(MOODS)} + 1] AS emotion FROM part)
SELECT p_partkey, md5(concat_ws(', ', CASE WHEN variant % 2 = 0 THEN p_name ELSE p_type END,
  CASE WHEN k NOT IN ({', '.join(quote(s) for s in fixed.ART_STYLES if s != 'photo')}) THEN 'inspired by the lyric "' || p_name || '"' END,
  CASE WHEN emotion <> 'neutral' THEN emotion || ' mood' END,
  CASE WHEN variant > 0 THEN views[variant % 6 + 1] END, replace(tpl, '{{palette}}', pal), 'subtle ' || p_type || ' undertone',
  {quote(fixed.NO_TEXT)}, CASE WHEN variant <> 3 THEN 'no hands, no fingers' END,
  CASE WHEN variant <> 3 THEN 'without hands or fingers' END)) AS prompt
FROM x JOIN s USING (style) JOIN m USING (emotion), v""")
def fn16(t):
    k = F.col("p_partkey")
    df = t("part").select(
        "p_partkey", (k % 4).alias("variant"), tx.cyclic_pick(k, STYLES).alias("style"),
        tx.cyclic_pick(k, MOODS).alias("emotion"), F.array("p_name", "p_type").alias("queries"),
        F.col("p_name").alias("lyric"), F.col("p_type").alias("theme"),
        F.when(k % 4 == 3, "").otherwise(" hands ,, fingers").alias("avoid"))
    return tx.assemble_prompt(df).select("p_partkey", F.md5("prompt").alias("prompt"))


@query("fn17_content_key", "SELECT doc_id, sha256(lang || chr(31) || doc_id || chr(31) || text) AS k FROM documents")
def fn17(t):
    return t("documents").select("doc_id", hs.content_key("lang", "doc_id", "text").alias("k"))


def sql_hash(vec: str) -> str:
    return (f"list_sum(list_transform(range(1, 64), lambda i: CASE WHEN {vec}[i] > {vec}[i + 1] "
            f"THEN 1::BIGINT << (63 - i) ELSE 0 END))::BIGINT")


@query("fn18_gradient_hash", f"SELECT vec_id, {sql_hash('embedding')} AS h FROM embeddings")
def fn18(t):
    return t("embeddings").select("vec_id", hs.gradient_hash("embedding", 64, 1).alias("h"))


@query("fn18_gradient_hash_grid", """SELECT vec_id, list_sum(list_transform(range(56), lambda k:
  CASE WHEN embedding[(k // 7) * 8 + k % 7 + 1] > embedding[(k // 7) * 8 + k % 7 + 2] THEN 1::BIGINT << (55 - k) ELSE 0 END))::BIGINT
  AS h FROM embeddings""")
def fn18_grid(t):
    return t("embeddings").select("vec_id", hs.gradient_hash("embedding", 8, 8).alias("h"))


@query("fn19_hamming", f"""WITH h AS (SELECT vec_id, {sql_hash('embedding')} AS h FROM embeddings)
SELECT a.vec_id, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM h a JOIN h b ON b.vec_id = a.vec_id + 1""")
def fn19(t):
    h = t("embeddings").select("vec_id", hs.gradient_hash_long("embedding").alias("h"))
    nxt = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("g"))
    return h.join(nxt, "vec_id").select("vec_id", hs.hamming("h", "g").alias("distance"))


WRAP = 40


def with_words(t):
    """Documents with a word. A filter on what is made of the words would make Spark work that out twice."""
    return t("documents").filter(F.col("text").rlike(r"(?U)\S"))


@query("fn20_wrap_text", f"""WITH RECURSIVE w AS (SELECT doc_id, {sql_words('text')} AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
z AS (SELECT doc_id, x, i, length(x) AS n, CASE WHEN length(x) > {WRAP} THEN CAST(ceil(length(x) / {WRAP - 1}) AS INTEGER) ELSE 1 END AS p FROM u),
f AS (SELECT doc_id, i, 0::BIGINT AS line, CASE WHEN p > 1 THEN n - (p - 1) * {WRAP - 1} ELSE n END AS cur, p - 1 AS extra FROM z WHERE i = 1
  UNION ALL SELECT z.doc_id, z.i, CASE WHEN f.cur + 1 + z.n > {WRAP} THEN f.line + f.extra + 1 ELSE f.line + f.extra END,
  CASE WHEN z.p > 1 THEN z.n - (z.p - 1) * {WRAP - 1} WHEN f.cur + 1 + z.n > {WRAP} THEN z.n ELSE f.cur + 1 + z.n END, z.p - 1
  FROM f JOIN z ON z.doc_id = f.doc_id AND z.i = f.i + 1)
SELECT doc_id, max(line + extra) + 1 AS n_lines, CAST(sum(line * i) AS BIGINT) AS checksum FROM f GROUP BY 1""")
def fn20(t):
    """Number of lines, and a checksum of which line every word starts on."""
    lines = tx.wrap_text("text", WRAP)
    d = with_words(t).select("doc_id", lines.alias("ls"))
    # a broken word spans lines ending in "-": count the words that begin on each line
    x = d.select("doc_id", F.size("ls").cast("long").alias("n_lines"), F.posexplode_outer("ls").alias("line", "x"))
    x = x.withColumn("n", F.size(F.split("x", " ")))
    return _wrap_checksum(t, x)


NARROW = "fijlrtI.,'!-"
ROOM = 44  # narrow characters count 1, others 2


def sql_width(x: str) -> str:
    return (f"2 * length({x}) - length(regexp_replace({x}, '[^{NARROW.replace("'", "''").replace('-', '')}-]', '', 'g'))")


@query("fn20_wrap_measured", f"""WITH RECURSIVE w AS (SELECT doc_id, {sql_words('text')} AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
v AS (SELECT DISTINCT x, {sql_width('x')} AS n FROM u),
c AS (SELECT x, 1 AS pos, 0 AS k, left(x, 1) AS piece, {sql_width('left(x, 1)')} AS n FROM v WHERE n > {ROOM}
  UNION ALL SELECT x, pos + 1, CASE WHEN n + {sql_width('substr(x, pos + 1, 1)')} + 1 > {ROOM} THEN k + 1 ELSE k END,
    CASE WHEN n + {sql_width('substr(x, pos + 1, 1)')} + 1 > {ROOM} THEN substr(x, pos + 1, 1) ELSE piece || substr(x, pos + 1, 1) END,
    CASE WHEN n + {sql_width('substr(x, pos + 1, 1)')} + 1 > {ROOM} THEN 0 ELSE n END + {sql_width('substr(x, pos + 1, 1)')} FROM c WHERE pos < length(x)),
p AS (SELECT x, k, max_by(piece, pos) AS piece, max_by(n, pos) AS n, max(k) OVER (PARTITION BY x) AS final FROM c GROUP BY x, k),
z AS (SELECT doc_id, i, v.x, v.n, coalesce(q.final, 0) AS extra, coalesce(q.n, v.n) AS rest FROM u JOIN v USING (x) LEFT JOIN p q ON q.x = v.x AND q.k = q.final),
f AS (SELECT doc_id, i, x, 0::BIGINT AS line, rest AS cur, extra FROM z WHERE i = 1
  UNION ALL SELECT z.doc_id, z.i, z.x, f.line + f.extra + CASE WHEN f.cur + 2 + z.n > {ROOM} THEN 1 ELSE 0 END,
    CASE WHEN f.cur + 2 + z.n > {ROOM} THEN z.rest ELSE f.cur + 2 + z.n END, z.extra FROM f JOIN z ON z.doc_id = f.doc_id AND z.i = f.i + 1),
g AS (SELECT doc_id, i, line + coalesce(k, 0) AS line, CASE WHEN k IS NULL THEN f.x WHEN k < final THEN piece || '-' ELSE piece END AS part
  FROM f LEFT JOIN p ON p.x = f.x AND f.extra > 0),
h AS (SELECT doc_id, line, string_agg(part, ' ' ORDER BY i) AS t FROM g GROUP BY ALL)
SELECT doc_id, count(*) AS n_lines, md5(string_agg(t, chr(10) ORDER BY line)) AS lines FROM h GROUP BY 1""")
def fn20_measured(t):
    """Whole texts wrapped by a measure with two widths; the lines themselves are compared."""
    lines = tx.wrap_measured("text", ROOM, {c: 1 for c in NARROW}, 2)
    d = with_words(t).select("doc_id", lines.alias("ls"))
    return d.select("doc_id", F.size("ls").cast("long").alias("n_lines"), F.md5(F.array_join("ls", "\n")).alias("lines"))


def _wrap_checksum(t, x):
    from pyspark.sql import Window
    # a document is one row and its lines stay few: a plain window per document is bounded by it
    w = Window.partitionBy("doc_id").orderBy("line")
    x = x.withColumn("cont", F.coalesce(
        (F.length(F.lag("x").over(w)) == WRAP) & F.lag("x").over(w).endswith("-")
        & (F.instr(F.lag("x").over(w), " ") == 0), F.lit(False)).cast("int"))
    x = x.withColumn("starts", F.col("n") - F.col("cont"))
    x = x.withColumn("before", F.coalesce(F.sum("starts").over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = F.col("starts")
    part = F.col("line") * (s * F.col("before") + s * (s + 1) / 2)
    return x.groupBy("doc_id", "n_lines").agg(F.sum(part).cast("long").alias("checksum"))


@query("fn21_block_size", """WITH w AS (SELECT p_partkey, p_name || ' ' || p_type AS x, length(p_name) AS a, length(p_type) AS b FROM part)
SELECT p_partkey, CASE WHEN length(x) <= 16 THEN length(x) ELSE greatest(a, b) END AS w,
  CASE WHEN length(x) <= 16 THEN 20 ELSE 48 END AS h FROM w""")
def fn21(t):
    """Names (all of up to 16 letters) wrap before the type or not at all."""
    name = F.concat_ws(" ", F.regexp_replace("p_name", " ", "_"), "p_type")
    d = t("part").select(
        "p_partkey", tx.wrap_text(name, 16).alias("ls"))
    b = tx.block_size(F.col("ls"), 20, 8)
    return d.select("p_partkey", b["w"].cast("long").alias("w"), b["h"].alias("h"))


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("fn22_dominant", """WITH x AS (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY ALL)
SELECT user_id, event_type AS dominant FROM x QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_type) = 1""")
def fn22(t):
    from cuework.operators.aggregates import emotion_totals
    tot = emotion_totals(t("events"), ["user_id"], "event_type", "value", TYPES)
    return tot.select("user_id", tx.dominant(TYPES).alias("dominant"))


@query("fn23_publish_metadata", f"""WITH {EACH_SQL} SELECT doc_id, line, md5(CASE WHEN x = '' THEN 'Untitled' ELSE left(x, 100) END) AS title,
  md5(left(text, 4900)) AS description,
  md5(array_to_string(list_filter(list_transform(string_split(x, ','), lambda y: {sql_strip('y')}), lambda y: y <> '')[1:30], '|')) AS tags FROM l""")
def fn23(t):
    """Every line as a title and a list of tags, with the whole text as description."""
    m = tx.publish_metadata("x", "text", F.split("x", ","))
    return each_line(t, "text").select("doc_id", "line", F.md5(m["title"]).alias("title"), F.md5(m["description"]).alias("description"),
                                       F.md5(F.array_join(m["tags"], "|")).alias("tags"))


@query("fn24_append_mention", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE
  CASE WHEN p_partkey % 3 = 1 THEN p_name || ' @' || upper(p_brand) ELSE p_name || chr(10) || '🎤 @' || p_brand END END AS body FROM part""")
def fn24(t):
    k = F.col("p_partkey") % 3
    body = F.when(k == 1, F.concat("p_name", F.lit(" @"), F.upper("p_brand"))).otherwise(
        F.when(k == 2, F.concat("p_name", F.lit("  "))).otherwise(F.col("p_name")))
    handle = F.when(k == 0, "").otherwise(F.concat(F.lit("@"), "p_brand"))
    return t("part").select("p_partkey", tx.append_mention(body, handle).alias("body"))


@query("fn25_rotate_queries", """WITH x AS (SELECT p_partkey AS k, string_split(p_name, ' ') AS o, [p_type, p_brand, 'extra'] AS th,
  [p_type, 'song one', 'song two', 'song three', 'song one'] AS song FROM part),
y AS (SELECT *, th[k % 3 + 1:] || th[:k % 3] AS rot FROM x),
z AS (SELECT *, CASE WHEN k % 2 = 0 THEN o[1:1] || rot[1:1] || o[2:] || rot[2:2] ELSE rot[1:3] END AS s FROM y),
f AS (SELECT *, list_filter(song, lambda q, i: NOT list_contains(s, q) AND list_position(song, q) = i) AS fill FROM z)
SELECT k AS p_partkey, array_to_string((s || fill)[1:greatest(5, len(s))], '|') AS queries FROM f""")
def fn25(t):
    k = F.col("p_partkey")
    own = F.when(k % 2 == 0, F.split("p_name", " ")).otherwise(F.array().cast("array<string>"))
    song = F.array(F.col("p_type"), *map(F.lit, ["song one", "song two", "song three", "song one"]))
    q = tx.rotate_queries(own, F.array("p_type", "p_brand", F.lit("extra")), k, song)
    return t("part").select("p_partkey", F.array_join(q, "|").alias("queries"))


@query("fn26_cyclic_pick", """SELECT event_id, ['lower', 'center', 'lower', 'upper'][event_id % 4 + 1] AS band FROM events""")
def fn26(t):
    return t("events").select("event_id", tx.cyclic_pick(F.col("event_id"), fixed.SUBTITLE_BANDS)
                              .alias("band"))


@query("fn27_hashed_pick", f"""SELECT event_id, [{', '.join(f"'{n}'" for n, _ in fixed.TRANSITIONS['archiveCollage'])}][
  CAST(('0x' || md5(user_id || '|' || event_id)[1:8])::BIGINT % {len(fixed.TRANSITIONS['archiveCollage'])} AS INTEGER) + 1] AS transition FROM events""")
def fn27(t):
    names = [n for n, _ in fixed.TRANSITIONS["archiveCollage"]]
    pick = tx.hashed_pick(["user_id", "event_id"], len(names))
    return t("events").select("event_id", F.element_at(F.array(*map(F.lit, names)), pick + 1)
                              .alias("transition"))


@query("fn28_expand_queries", """WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS a,
  CASE WHEN p_partkey % 2 = 0 THEN p_name || ' (Official Video)' ELSE p_brand || ' - ' || p_name END AS t,
  p_partkey % 3 <> 0 AS known, p_brand AS ca, p_name AS ct FROM part),
q AS (SELECT *, list_filter([CASE WHEN known THEN {'kind': 'exact', 'artist': ca, 'title': ct, 'query': NULL::VARCHAR} END,
  CASE WHEN known AND a <> '' THEN {'kind': 'exact', 'artist': a, 'title': t, 'query': NULL::VARCHAR} END,
  {'kind': 'search', 'artist': NULL, 'title': NULL, 'query': ca || ' ' || ct},
  {'kind': 'search', 'artist': NULL, 'title': NULL, 'query': ct},
  {'kind': 'search', 'artist': NULL, 'title': NULL, 'query': CASE WHEN a <> '' THEN a || ' ' || t ELSE t END}],
  lambda r: r IS NOT NULL) AS qs FROM x)
SELECT p_partkey, CAST(unnest(range(len(qs))) AS INTEGER) AS query_index, unnest(qs, recursive := true) FROM q""")
def fn28(t):
    k = F.col("p_partkey")
    df = t("part").select(
        "p_partkey", F.when(k % 2 == 0, F.col("p_brand")).otherwise("").alias("artist"),
        F.when(k % 2 == 0, F.concat("p_name", F.lit(" (Official Video)")))
        .otherwise(F.concat("p_brand", F.lit(" - "), "p_name")).alias("title"),
        F.when(k % 3 != 0, F.lit(200.0)).alias("duration"))
    return tx.expand_queries(df, ["p_partkey"])


# --- predicates ----------------------------------------------------------------------------------------------------

URL_SQL = """CASE page_id % 6 WHEN 0 THEN 'https://www.youtube.com/watch?v=' || left(md5(url), 11) || '&t=3'
  WHEN 1 THEN 'http://youtu.be/' || left(md5(url), 11) WHEN 2 THEN 'https://m.youtube.com/shorts/' || left(md5(url), 11)
  WHEN 3 THEN 'https://youtu.be.evil.example/' || left(md5(url), 11) WHEN 4 THEN 'https://www.youtube.com/watch?v=' || left(md5(url), 10)
  ELSE url END"""


@query("f1_extract_video_id", f"""WITH u AS (SELECT page_id, {URL_SQL} AS u, left(md5(url), 11) AS v FROM pages)
SELECT page_id, CASE WHEN page_id % 6 <= 2 THEN v END AS video_id FROM u""")
def f1(t):
    return t("pages").select("page_id", pr.extract_video_id(F.expr(URL_SQL)).alias("video_id"))


@query("f1_url_parts", """SELECT page_id, regexp_extract(url, '^(\\w+)://', 1) AS protocol, regexp_extract(url, '://([^/?#]+)', 1) AS host,
  regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query,
  nullif(regexp_extract(url, '#(.*)$', 1), '') AS ref FROM pages""")
def f1_parts(t):
    return t("pages").select("page_id", pr.url_parts("url").alias("u")).select("page_id", "u.*")


MESSAGES = {"error": "ERROR: Connection timed out", "signup": "Sign in to confirm your age",
            "click": "Private video. Sorry", "view": "Unsupported URL: x"}
MSG_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MESSAGES.items()) + \
    " ELSE 'blocked in region ' || user_id || CASE WHEN event_id % 2 = 0 THEN '' ELSE ' at odd times' END END"


@query("f2_classify_message", """SELECT event_id, CASE event_type WHEN 'error' THEN 'network' WHEN 'signup' THEN 'restricted'
  WHEN 'click' THEN 'unavailable' WHEN 'view' THEN 'invalid_url' ELSE 'restricted' END AS code FROM events""")
def f2(t):
    return t("events").select("event_id", pr.classify_message(F.expr(MSG_SQL))["code"].alias("code"))


@query("f3_valid_key", "SELECT doc_id, doc_id % 3 = 0 AS ok FROM documents")
def f3(t):
    k = F.md5("text")
    x = F.when(F.col("doc_id") % 3 == 0, k).when(F.col("doc_id") % 3 == 1, F.concat(k, F.lit("../"))).otherwise(
        F.concat(F.lit("Z"), F.substring(k, 2, 31)))
    return t("documents").select("doc_id", pr.valid_key(x).alias("ok"))


PART_MEDIA_SQL = """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'video' WHEN 6 THEN 'gif' ELSE 'photo' END AS kind,
  CAST(700 + p_size * 30 AS INTEGER) AS width, CAST(p_retailprice * 1.2 + p_partkey % 11 * 100 AS INTEGER) AS height,
  CASE WHEN p_partkey % 13 = 0 THEN p_name || ' logo' ELSE p_name END AS tags, CAST(p_size AS DOUBLE) AS duration FROM part"""


def part_media(t):
    k = F.col("p_partkey")
    return t("part").select(
        "p_partkey", "p_brand", "p_name", "p_type",
        F.when(k % 7 == 0, "video").when(k % 7 == 6, "gif").otherwise("photo").alias("kind"),
        (700 + F.col("p_size") * 30).cast("int").alias("width"),
        F.round(F.col("p_retailprice") * 1.2 + k % 11 * 100).cast("int").alias("height"),
        F.when(k % 13 == 0, F.concat("p_name", F.lit(" logo"))).otherwise(F.col("p_name")).alias("tags"),
        F.col("p_size").cast("double").alias("duration"))


REJECT_SQL = """CASE WHEN contains(tags, 'logo') THEN 'looks watermarked/branded/text-heavy'
  WHEN kind = 'photo' AND height > width AND (width < 1080 OR height < 1600) THEN 'too small (' || width || 'x' || height || ') — would need enlargement'
  WHEN kind = 'photo' AND height <= width AND least(width, height) < 1400 THEN 'too small for landscape adaptation (' || width || 'x' || height || ')'
  WHEN kind = 'video' AND height < 1080 THEN 'video below 1080 vertical (' || width || 'x' || height || ')'
  WHEN kind = 'video' AND duration < 16.0 THEN printf('video too short (%.1fs for a 20.0s scene)', duration)
  WHEN kind = 'gif' THEN 'unsupported kind ''gif''' END"""


@query("f4_reject_reason", f"WITH m AS ({PART_MEDIA_SQL}) SELECT p_partkey, {REJECT_SQL} AS reason FROM m")
def f4(t):
    return part_media(t).select("p_partkey", pr.reject_reason(F.lit(20.0)).alias("reason"))


@query("f9_adaptation", f"""WITH m AS ({PART_MEDIA_SQL}) SELECT p_partkey, CASE WHEN height >= width THEN 'portrait_crop'
  WHEN p_partkey % 2 = 0 THEN 'layered_frame' WHEN height * 1.2 >= 1600 THEN 'subject_crop' ELSE 'blur_fill' END AS fit FROM m""")
def f9(t):
    style = F.when(F.col("p_partkey") % 2 == 0, "archiveCollage").otherwise("cinemaStill")
    return part_media(t).select("p_partkey", pr.adaptation("width", "height", style).alias("fit"))


@query("f10_is_drawn", """SELECT p_partkey, p_partkey % 4 = 0 AND p_partkey % 3 = 0 AS drawn FROM part""")
def f10(t):
    k = F.col("p_partkey")
    return t("part").select("p_partkey", pr.is_drawn(
        F.when(k % 4 == 0, "fal.ai").otherwise("pexels"),
        F.concat(F.lit("/media/"), F.when(k % 3 == 0, "drawn_").otherwise("gen_drawn_"), "p_name")).alias("drawn"))


KINDS = ["render", "plan", "lyrics", "analyze", "download", "publish_youtube", "subtitle_preview", "bogus"]


@query("f12_validate_requests", f"""WITH q AS (SELECT o_orderkey, {KINDS!r}[o_orderkey % 8 + 1] AS kind, o_orderkey % 5 <> 0 AS src,
  o_totalprice / 3000 AS target, o_orderkey % 3 <> 0 AS style_ok, o_orderkey % 7 <> 0 AS other_ok FROM orders)
SELECT o_orderkey, CASE WHEN kind = 'bogus' THEN 'invalid_request' WHEN kind <> 'download' AND NOT src THEN 'not_found'
  WHEN kind = 'publish_youtube' AND NOT other_ok THEN 'invalid_request' WHEN kind = 'render' AND NOT style_ok THEN 'invalid_request'
  WHEN kind IN ('plan', 'subtitle_preview') AND (NOT style_ok OR target < 5 OR target > 120) THEN 'invalid_request'
  WHEN kind = 'lyrics' AND NOT other_ok THEN 'invalid_request' WHEN kind = 'analyze' AND (target < 10 OR target > 120) THEN 'invalid_request'
  WHEN kind = 'download' AND NOT style_ok THEN 'not_authorized' WHEN kind = 'download' AND NOT other_ok THEN 'invalid_url' ELSE 'ok' END AS outcome
FROM q""")
def f12(t):
    k = F.col("o_orderkey")
    df = t("orders").select(
        "o_orderkey", tx.cyclic_pick(k, KINDS).alias("kind"),
        F.when(k % 5 != 0, F.md5(k.cast("string"))).otherwise("../x").alias("source_job_id"),
        (F.col("o_totalprice") / 3000).alias("target_seconds"),
        F.when(k % 3 != 0, "minimalDark").otherwise("none").alias("style"), (k % 3 != 0).alias("authorized"),
        F.when(k % 7 != 0, "public").otherwise("hidden").alias("privacy"),
        F.when(k % 7 != 0, "song").otherwise("  ").alias("title"),
        F.when(k % 7 != 0, "https://youtu.be/abcdefghijk").otherwise("https://example.com/x").alias("url"))
    good, bad = pr.validate_requests(df)
    return good.select("o_orderkey", F.lit("ok").alias("outcome")).unionByName(
        bad.select("o_orderkey", F.col("error_code").alias("outcome")))


@query("f13_contract_report", """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_quantity <= 40 AS a, l_discount <= 0.08 AS b,
  l_returnflag IN ('A', 'N') AS d FROM lineitem), u AS (SELECT *, a AND b AND d AS all_passed FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, all_passed, 'quantity' AS "check", a AS passed FROM u
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, all_passed, 'discount', b FROM u
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, all_passed, 'flag', d FROM u""")
def f13(t):
    return pr.contract_report(t("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], {
        "quantity": F.col("l_quantity") <= 40, "discount": F.col("l_discount") <= 0.08,
        "flag": F.col("l_returnflag").isin("A", "N")})


# --- lexicon ------------------------------------------------------------------------------------------------------

# stems of the invented prose, nested ones included, next to the real lexicon
CORPUS = [
    ("the", ["article"], {"calm": 1}, ["the phrase", "shared phrase"]),
    ("th", ["prefix"], {"hope": 1}, ["th phrase"]),
    ("and", ["link", "article"], {"joy": 1, "calm": 1}, ["and phrase", "shared phrase"]),
    ("on", ["place"], {"longing": 1}, ["on phrase"]),
    ("ion", ["ending"], {"energy": 2}, ["ion phrase"]),
]


def corpus_lexicon(t):
    spark = t("documents").sparkSession
    return jn.lexicon(spark, fixed.LEXICON + CORPUS)


LEX_ROWS = fixed.LEXICON + CORPUS
LEX_SQL = "lex(stem) AS (VALUES " + values([(x[0],) for x in LEX_ROWS]) + ")"
EMO_SQL = "emo(stem, name, w) AS (VALUES " + values([
    (stem, name, w) for stem, _, emotions, _ in LEX_ROWS for name, w in emotions.items()]) + ")"
SUBJ_SQL = "subj(stem, subject, sp) AS (VALUES " + values([
    (stem, s, i) for stem, subjects, _, _ in LEX_ROWS for i, s in enumerate(subjects)]) + ")"
MATCH_SQL = f"""{LEX_SQL}, w AS (SELECT doc_id, {sql_words(SEM_NORM_SQL)} AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS token, unnest(range(len(ws))) AS i FROM w),
d AS (SELECT doc_id, token, min(i) AS i FROM u GROUP BY ALL),
k AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM d),
voc AS (SELECT DISTINCT token FROM k),
best AS (SELECT token, arg_max(stem, length(stem)) AS stem FROM voc JOIN lex ON starts_with(token, stem)
  AND (length(stem) >= 3 OR token = stem) GROUP BY 1),
hit AS (SELECT doc_id, stem, min(pos) AS pos FROM k JOIN best USING (token) GROUP BY ALL)"""


@query("j1_lexicon_match", f"""WITH {MATCH_SQL} SELECT doc_id, stem,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos FROM hit""")
def j1(t):
    return jn.lexicon_match(t("documents"), corpus_lexicon(t), DOC, "text")


@query("j1_lexicon_match_join", f"""WITH {MATCH_SQL} SELECT doc_id, stem,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos FROM hit""")
def j1_join(t):
    return jn.lexicon_join(jn.text_tokens(t("documents"), DOC, "text"), corpus_lexicon(t), DOC)


@query("j2_extract_semantics", f"""WITH {MATCH_SQL}, {EMO_SQL}, {SUBJ_SQL},
e AS (SELECT doc_id, {', '.join(f"sum(CASE WHEN name = '{n}' THEN w ELSE 0 END) AS {n}" for n in fixed.EMOTIONS)}, sum(w) AS tot
  FROM hit JOIN emo USING (stem) GROUP BY 1),
s0 AS (SELECT doc_id, subject, min(pos * 10 + sp) AS o FROM hit JOIN subj USING (stem) GROUP BY ALL),
s AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o) <= 6),
sj AS (SELECT doc_id, string_agg(subject, '|' ORDER BY o) AS subjects FROM s GROUP BY 1),
mt AS (SELECT doc_id, count(*) AS n_matched FROM hit GROUP BY 1)
SELECT doc_id, coalesce(subjects, '') AS subjects, CAST(coalesce(n_matched, 0) AS INTEGER) AS n_matched,
  {', '.join(f'coalesce(round_even({n} / tot, 3), 0)::DOUBLE AS {n}' for n in fixed.EMOTIONS)}
FROM documents LEFT JOIN e USING (doc_id) LEFT JOIN sj USING (doc_id) LEFT JOIN mt USING (doc_id)""")
def j2(t):
    s = jn.extract_semantics(t("documents"), DOC, "text", corpus_lexicon(t))
    return s.select("doc_id", F.array_join("subjects", "|").alias("subjects"),
                    F.size("matched").alias("n_matched"), *fixed.EMOTIONS)


# --- matching and ranking -------------------------------------------------------------------------------------------

@query("j3_match_candidates", f"""WITH x AS (SELECT p_partkey, p_brand, p_name, {NOISY_SQL} AS title, p_size, p_type FROM part),
n AS (SELECT *, {sql_title('title')} AS a, {sql_title('p_name')} AS b, {sql_title('p_brand')} AS c, {sql_title("p_brand || ' band'")} AS d FROM x),
s AS (SELECT p_partkey, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS ts, 1 - levenshtein(c, d) / greatest(length(c), length(d)) AS ar,
  greatest(0, 1 - abs(p_size - 20) / 15) AS du, p_partkey % 2 AS syn, p_partkey % 11 = 0 AS inst FROM n),
q AS (SELECT p_partkey, (0.35 * ts + 0.25 * ar + 0.20 * du + 0.15 * syn + 0.05 * 0.2) * CASE WHEN inst THEN 0.1 ELSE 1 END AS score FROM s)
SELECT p_partkey, round(score, 5)::DOUBLE AS score FROM q WHERE score >= 0.35""")
def j3(t):
    p, k = t("part"), F.col("p_partkey")
    req = p.select("p_partkey", F.concat("p_brand", F.lit(" band")).alias("artist"),
                   F.col("p_name").alias("title"), F.lit(20.0).alias("duration"))
    cand = p.select("p_partkey", F.col("p_brand").alias("artist"), noisy().alias("title"),
                    F.col("p_size").cast("double").alias("duration"),
                    F.col("p_name").alias("plain_text"),
                    F.when(k % 2 == 1, "[00:01.0] x").otherwise(" ").alias("lrc_text"),
                    (k % 11 == 0).alias("instrumental"))
    out = jn.match_candidates(req, cand, ["p_partkey"], "levenshtein")
    return out.select("p_partkey", r("score", 5).alias("score"))


@query("j3_match_candidates_ratio")
def j3_ratio(t):
    p = t("part")
    req = p.select("p_partkey", F.col("p_brand").alias("artist"), F.col("p_name").alias("title"),
                   F.lit(20.0).alias("duration"))
    cand = p.select("p_partkey", F.col("p_brand").alias("artist"), noisy().alias("title"),
                    F.col("p_size").cast("double").alias("duration"), F.col("p_name").alias("plain_text"),
                    F.lit("").alias("lrc_text"), F.lit(False).alias("instrumental"))
    return jn.match_candidates(req, cand, ["p_partkey"]).select("p_partkey", "title_sim", "score")


@query("j3_similar_titles", f"""WITH a AS (SELECT DISTINCT {sql_title('p_name')} AS l FROM part), b AS (SELECT DISTINCT {sql_title(NOISY_SQL)} AS r FROM part),
x AS (SELECT l, r, list_distinct(string_split(l, ' ')) AS lw, list_distinct(string_split(r, ' ')) AS rw FROM a, b WHERE l <> '' AND r <> ''),
j AS (SELECT l, r, len(list_intersect(lw, rw)) / (len(lw) + len(rw) - len(list_intersect(lw, rw))) AS jac FROM x)
SELECT l AS left_title, r AS right_title, round(jac, 6) AS jaccard FROM j WHERE jac >= 0.5""")
def j3_titles(t):
    p = t("part")
    out = jn.similar_titles(p.select(F.col("p_name").alias("title")), p.select(noisy().alias("title")))
    return out.select("left_title", "right_title", r("jaccard").alias("jaccard"))


@query("k1_rank_candidates", """SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank
FROM part QUALIFY rank <= 5""")
def k1(t):
    df = t("part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("score"),
                          F.col("p_partkey").alias("input_pos"))
    return rk.rank_candidates(df, ["p_brand"], 5).select("p_brand", "p_partkey", "rank")


@query("k2_rank_media", f"""WITH m AS ({PART_MEDIA_SQL.replace('FROM part', ', p_brand, p_name, p_type FROM part')}),
sc AS (SELECT p_brand, min(p_name) AS q, min(p_type) AS s FROM part GROUP BY 1),
x AS (SELECT m.*, {REJECT_SQL} AS reason, len(list_intersect({sql_token_set("q || ' ' || s || ' ring gear'")}, {sql_token_set("tags || ' ' || p_type")})) AS ov
  FROM m JOIN sc ON sc.p_brand = m.p_brand),
y AS (SELECT *, CASE WHEN kind = 'photo' THEN least(width / 1080, height / 1920) WHEN height > width THEN height / 1920 ELSE height / 1080 END AS head FROM x WHERE reason IS NULL),
z AS (SELECT p_brand, p_partkey, 0.45 * least(1, ov / 4) + 0.25 * CASE WHEN height > width THEN 1 WHEN height = width THEN 0.6 ELSE 0.35 END
  + 0.20 * least(1, greatest(0, (head - 0.8) / 1.2)) + 0.10 * CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.85 ELSE 0.7 END AS score FROM y)
SELECT p_brand, p_partkey, round(score, 5)::DOUBLE AS score, row_number() OVER (PARTITION BY p_brand ORDER BY round(score, 9) DESC, p_partkey) AS rank FROM z""")
def k2(t):
    k = F.col("p_partkey")
    scenes = t("part").groupBy("p_brand").agg(F.array(F.min("p_name")).alias("queries"),
                                              F.array(F.min("p_type")).alias("subjects"))
    scenes = scenes.withColumns({"lyric": F.lit("ring gear"), "scene_duration": F.lit(20.0)})
    cand = part_media(t).withColumns({
        "provider": tx.cyclic_pick(k, ["pexels", "pixabay", "unsplash", "other"]),
        "query": F.col("p_type"), "input_pos": k})
    ok, _ = rk.rank_media(cand, scenes, ["p_brand"])
    return ok.select("p_brand", "p_partkey", rk.nearest("score", 5).alias("score"), "rank")


@query("k4_order_with_override", """WITH p AS (SELECT *, event_type = 'purchase' AS picked FROM events)
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY picked DESC, CASE WHEN picked THEN -event_id ELSE event_id END) - 1 AS place FROM p""")
def k4(t):
    e = t("events").select("event_id", "user_id", "event_type")
    picks = of_type(e, "purchase").select("user_id", "event_id", (-F.col("event_id")).alias("pick_pos"))
    return rk.order_with_override(e, picks, ["user_id"], "event_id", "event_id").select("event_id", "place")


@query("k5_list_newest", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC")
def k5(t):
    return rk.list_newest(t("orders"), "o_orderdate", "o_orderkey").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("k6_cap_list", """SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 6""")
def k6(t):
    return rk.cap_list(t("events").select("user_id", "event_id", "value"), ["user_id"],
                       [F.col("value").desc(), F.col("event_id").asc()], 6).select("user_id", "event_id")


# --- duplicates, tags, overlap ------------------------------------------------------------------------------------------

COPIES_SQL = f"""v AS (SELECT vec_id, embedding AS e FROM embeddings UNION ALL
  SELECT vec_id + 1000000, list_reverse(embedding[1:8]) || embedding[9:] FROM embeddings),
h AS (SELECT vec_id, {sql_hash('e')} AS h FROM v)"""


def copies(t):
    e = t("embeddings").select("vec_id", "embedding")
    turned = e.select((F.col("vec_id") + 1000000).alias("vec_id"), F.concat(
        F.reverse(F.slice("embedding", 1, 8)), F.slice("embedding", 9, 56)).alias("embedding"))
    return e.unionByName(turned).select("vec_id", hs.gradient_hash_long("embedding").alias("h"))


@query("j10_near_duplicates", f"""WITH {COPIES_SQL}, d AS (SELECT DISTINCT h FROM h)
SELECT a.h AS hash_a, b.h AS hash_b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM d a JOIN d b ON a.h < b.h
WHERE bit_count(xor(a.h, b.h)) <= 8""")
def j10(t):
    return jn.near_duplicates(copies(t), "h", 8, bits=63)


@query("j10_hash_groups", f"WITH {COPIES_SQL} SELECT h, min(vec_id) AS representative, count(*) AS copies FROM h GROUP BY 1")
def j10_groups(t):
    return jn.hash_groups(copies(t), "h", "vec_id")


LIB = {"warm": ["red", "hot", "ring"], "cool": ["blue", "cold", "bolt"], "small": ["small", "tiny", "ring"],
       "large": ["large", "big", "gear"]}


@query("j12_best_tag_match", f"""WITH lib(name, tags) AS (VALUES {', '.join(f'({quote(k)}, {v!r})' for k, v in LIB.items())}),
s AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: CASE x WHEN 'widget' THEN 'gear' WHEN 'green' THEN 'cold' ELSE x END) AS ss FROM part),
o AS (SELECT p_partkey, name, len(list_filter(ss, lambda x: list_contains(tags, x))) AS n FROM s, lib),
b AS (SELECT p_partkey, max(n) AS top FROM o GROUP BY 1),
c AS (SELECT o.p_partkey, top, list(name ORDER BY name) AS names FROM o JOIN b ON b.p_partkey = o.p_partkey AND n = top AND n > 0 GROUP BY ALL)
SELECT part.p_partkey, names[part.p_partkey % len(names) + 1] AS best_tag, CAST(coalesce(top, 0) AS INTEGER) AS overlap FROM part LEFT JOIN c USING (p_partkey)""")
def j12(t):
    df = t("part").select("p_partkey", F.split("p_name", " ").alias("subjects"))
    return jn.best_tag_match(df, ["p_partkey"], "subjects", "p_partkey", LIB,
                             {"widget": "gear", "green": "cold"})


@query("j16_token_overlap", f"""SELECT doc_id, round(least(1, len(list_intersect({sql_token_set('d.text')}, {sql_token_set('b.text')})) / 4), 4)::DOUBLE AS relevance
FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40""")
def j16(t):
    d = t("documents").withColumn("item_id", F.col("doc_id") % 40)
    b = t("benchmark").select("item_id", F.col("text").alias("other"))
    return d.join(b, "item_id").select("doc_id", jn.token_overlap(
        tx.token_set("text"), tx.token_set("other")).alias("relevance"))


@query("u2_ordered_union", f"""WITH {EACH_SQL}, n AS (SELECT *, coalesce(lead(x) OVER (PARTITION BY doc_id ORDER BY line), '') AS y FROM l),
w AS (SELECT doc_id, line, {sql_words('x')} || {sql_words('y')} AS ws FROM n)
SELECT doc_id, line, md5(array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), ' ')) AS words FROM w""")
def u2(t):
    """The words of every line and the next one."""
    lines = F.split("text", "\n")
    both = t("documents").select("doc_id", F.posexplode(F.transform(lines, lambda x, i: F.struct(
        x.alias("x"), F.coalesce(F.get(lines, i + 1), F.lit("")).alias("y")))).alias("line", "p"))
    return both.select("doc_id", "line", joined(tx.ordered_union(tx.words_of("p.x"), tx.words_of("p.y"))).alias("words"))


@query("u4_ordered_except", f"""WITH w AS (SELECT doc_id, {sql_words('text')} AS a, {sql_words(FIRST_SQL)} AS b FROM documents)
SELECT doc_id, md5(array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ' ')) AS words FROM w""")
def u4(t):
    return t("documents").select("doc_id", joined(tx.ordered_except(
        tx.words_of("text"), tx.words_of(first()))).alias("words"))
