"""Text and list functions. Column in, column out, all inside the JVM unless named ``*_exact``."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuework.functions import fixed_values as fixed


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside a lambda an outer expression would be
    computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def positions(df: DataFrame, keep: Sequence[str], array: Column, pos: str, value: str) -> DataFrame:
    """One row per element. The outer form keeps Spark from adding a "not empty" filter, which would
    work the array out a second time, and before any repartitioning."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, value))
    return rows.filter(F.col(pos).isNotNull())


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(_c(col), F.lit(""))


def _latin_folds() -> tuple[dict[str, str], dict[str, str]]:
    """Letters that compatibility decomposition turns into plain Latin: one letter, or several."""
    one, several = {}, {}
    for c in map(chr, (*range(0xC0, 0x250), *range(0x1D00, 0x1F00), *range(0x2C60, 0x2C80), *range(0xA720, 0xA800),
                       *range(0xFB00, 0xFB07), *range(0xFF21, 0xFF5B))):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c and plain.isascii() and plain.isalpha():
            (one if len(plain) == 1 else several)[c] = plain
    return one, several


FOLD, FOLD_SEVERAL = _latin_folds()


def fold(col: Column | str) -> Column:
    """Accented Latin letters, ligatures and full-width letters to plain ones; loose combining marks dropped."""
    given = text_or_empty(col)
    wide = given
    for c, plain in FOLD_SEVERAL.items():
        wide = F.replace(wide, F.lit(c), F.lit(plain))
    text = F.when(given.rlike(f"[{''.join(FOLD_SEVERAL)}]"), wide).otherwise(given)
    text = F.regexp_replace(F.translate(text, "".join(FOLD), "".join(FOLD.values())), r"\p{M}", "")
    # one look decides for the many texts that are plain already
    return F.when(given.rlike(r"[^\x00-\x7F]"), text).otherwise(given)


WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column | str) -> Column:
    """Trim all white space, not only blanks: what ``(?U)\\s`` matches, read from the ends only."""
    return F.btrim(_c(col), F.lit(WHITE_SPACE))


def words_of(col: Column | str) -> Column:
    """Split on white space, without empty parts."""
    return F.filter(F.split(text_or_empty(col), r"(?U)\s+"), lambda w: w != "")


def lines_of(col: Column | str) -> Column:
    """Split at any line break, lines stripped, empty ones kept."""
    return F.transform(F.split(text_or_empty(col), r"\R"), strip)


def normalize_token(col: Column | str) -> Column:
    low = F.translate(F.lower(fold(col)), "’", "'")
    return F.regexp_replace(low, r"[^\p{L}\p{N}_]+", "")


def normalize_words(col: Column | str) -> Column:
    """(raw, norm) of every word: the text is normalised in one go and split next to the raw one,
    as normalising keeps the white space. Words without a normal form stay, with an empty one."""
    low = F.translate(F.lower(fold(col)), "’", "'")
    norm = F.regexp_replace(low, r"(?U)[^\p{L}\p{N}_\s]+", "")
    pairs = F.arrays_zip(F.split(text_or_empty(col), r"(?U)\s").alias("raw"),
                         F.split(norm, r"(?U)\s").alias("norm"))
    return F.filter(pairs, lambda p: p["raw"] != "")


@F.pandas_udf(T.StringType())
def normalize_token_exact(col: pd.Series) -> pd.Series:
    """As :func:`normalize_token`, with full compatibility decomposition for any script."""
    def one(token: str | None) -> str:
        t = unicodedata.normalize("NFKD", token or "")
        t = "".join(c for c in t if not unicodedata.combining(c))
        return re.sub(r"[^\w]+", "", t.lower())
    return col.map(one)


def normalize_title(col: Column | str) -> Column:
    t = F.regexp_replace(fold(col), fixed.BRACKETED, " ")
    t = F.regexp_replace(t, fixed.TITLE_NOISE, " ")
    t = F.regexp_replace(F.lower(t), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def clean_track_name(col: Column | str) -> Column:
    t = F.regexp_replace(text_or_empty(col), fixed.BRACKETED, " ")
    t = F.split(t, r"(?U)\s+[|•·]\s+", 2)[0]
    t = F.regexp_replace(t, fixed.FEATURING, "")
    t = F.regexp_replace(t, fixed.TRACK_JUNK, " ")
    t = F.translate(t, "“”\"", "")
    return F.btrim(F.regexp_replace(t, r"(?U)\s{2,}", " "), F.lit(" -–—•·:|"))


def _split_at(raw: Column, sep: str) -> Column:
    at = F.instr(raw, sep)
    return F.struct(F.trim(F.substring(raw, F.lit(1), at - 1)).alias("artist"),
                    F.trim(F.substring(raw, at + len(sep), F.length(raw))).alias("title"))


def split_artist_title(col: Column | str) -> Column:
    """Struct (artist, title), cut at the first separator that occurs, in separator order."""
    raw = text_or_empty(col)
    out = None
    for sep in fixed.ARTIST_SEPARATORS:
        hit = F.instr(raw, sep) > 0
        out = F.when(hit, _split_at(raw, sep)) if out is None else out.when(
            hit, _split_at(raw, sep))
    return out.otherwise(F.struct(F.lit("").alias("artist"), F.trim(raw).alias("title")))


def guess_artist_title(title: Column | str, channel: Column | str) -> Column:
    """As above, but both parts must be there; else the channel name is the artist."""
    raw = F.trim(text_or_empty(title))
    name = F.trim(F.replace(text_or_empty(channel), F.lit(" - Topic"), F.lit("")))
    out = None
    for sep in fixed.GUESS_SEPARATORS:
        parts = _split_at(raw, sep)
        hit = (F.instr(raw, sep) > 0) & (parts["artist"] != "") & (parts["title"] != "")
        out = F.when(hit, parts) if out is None else out.when(hit, parts)
    return out.otherwise(F.struct(name.alias("artist"), raw.alias("title")))


def plain_lines(df: DataFrame, key: Sequence[str], col: str) -> DataFrame:
    """Non-empty stripped lines with their index among the kept ones."""
    kept = F.filter(lines_of(col), lambda x: x != "")
    return positions(df, key, kept, "line_index", "text")


def tokenize_lines(df: DataFrame, key: Sequence[str], col: str = "text",
                   line: str = "line_index", exact: bool = False) -> DataFrame:
    """Words of each line with their normal form; words without one are not counted."""
    if exact:
        # the normal form needs Python, so it is taken once per word and the index re-counted after
        long = (positions(df, [*key, line], words_of(col), "_p", "raw")
                .withColumn("norm", normalize_token_exact("raw")).filter("norm <> ''"))
        per = long.groupBy(*key, line).agg(F.array_sort(F.collect_list(
            F.struct("_p", "raw", "norm"))).alias("ts"))
        return (per.select(*key, line, F.posexplode("ts").alias("word_index", "t"))
                .select(*key, line, "word_index", "t.raw", "t.norm"))
    kept = F.filter(normalize_words(col), lambda p: p["norm"] != "")
    return positions(df, [*key, line], kept, "word_index", "t").select(
        *key, line, "word_index", "t.raw", "t.norm")


def tag_seconds(minutes: Column, seconds: Column, frac: Column) -> Column:
    whole = minutes.try_cast("int") * 60 + seconds.try_cast("int")
    f = F.when(frac.isNull() | (frac == ""), F.lit(0.0)).otherwise(
        frac.try_cast("int") / F.pow(F.lit(10.0), F.length(frac)))
    return whole.cast("double") + f


def _turkish(low: Column, words: Column) -> Column:
    hits = F.length(low) - F.length(F.translate(low, fixed.TURKISH_CHARS, ""))
    known = F.filter(words, lambda w: F.btrim(w, F.lit(".,!?'\"()")).isin(fixed.TURKISH_WORDS))
    by_char = hits >= F.greatest(F.lit(2.0), F.length(low) * F.lit(0.005))
    return (F.size(words) > 0) & (by_char | (F.size(known) / F.size(words) >= 0.08))


def looks_turkish(col: Column | str) -> Column:
    """Turkish letters (at least 2 and 0.5 % of the text) or common words (8 % of the words)."""
    low = F.lower(text_or_empty(col))
    return let(F.struct(low.alias("low"), words_of(low).alias("ws")),
               lambda v: _turkish(v["low"], v["ws"]))


def count_in(text: Column, chars: str) -> Column:
    """How many characters of a class the text holds."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{chars}+", ""))


def guess_language(col: Column | str) -> Column:
    """By common words and letters for Turkish, else by the share of a script among the letters."""
    t = text_or_empty(col)
    scripts = (fixed.ARABIC, fixed.ARABIC_FORMS, fixed.CYRILLIC, fixed.GREEK, fixed.GREEK_EXTENDED,
               fixed.HEBREW)

    def by_script(n: Column) -> Column:
        def share(block: str) -> Column:
            return count_in(t, f"[{block}]") / n > 0.3

        return (F.when(share(fixed.ARABIC) | share(fixed.ARABIC_FORMS), "ar")
                .when(share(fixed.CYRILLIC), "ru")
                .when(share(fixed.GREEK) | share(fixed.GREEK_EXTENDED), "el")
                .when(share(fixed.HEBREW), "he"))

    letters = F.greatest(F.lit(1), count_in(t, r"\p{L}"))
    return (F.when(looks_turkish(t), "tr")
            # one look decides for the many texts that hold none of these scripts
            .when(t.rlike("[" + "".join(scripts) + "]"), let(letters, by_script)))


def script_flags(col: Column | str) -> Column:
    t = text_or_empty(col)
    arabic, hebrew = t.rlike(f"[{fixed.ARABIC_ALL}]"), t.rlike(f"[{fixed.HEBREW}]")
    return F.struct(arabic.alias("has_arabic"), hebrew.alias("has_hebrew"),
                    (arabic | hebrew).alias("is_rtl"))


def _compositions() -> list[tuple[str, str, str]]:
    """(mark, letters, the same letters with the mark) of all Latin letters made of a letter and one mark."""
    out: dict[str, tuple[list[str], list[str]]] = {}
    for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            base, mark = (chr(int(x, 16)) for x in parts)
            if unicodedata.normalize("NFC", base + mark) == c:
                letters, made = out.setdefault(mark, ([], []))
                letters.append(base)
                made.append(c)
    return [(m, "".join(a), "".join(b)) for m, (a, b) in sorted(out.items())]


COMPOSITIONS = _compositions()


def compose(col: Column | str) -> Column:
    """Latin letters that are followed by combining marks become one letter; only texts with a mark are touched."""
    text = text_or_empty(col)
    # two rounds, for letters with two marks in any order
    table = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(row, ("mark", "letters", "made"))])
                      for row in COMPOSITIONS * 2])

    def join(t: Column, row: Column) -> Column:
        def end(p: Column, i: Column, last: Column) -> Column:
            c = F.right(p, F.lit(1))
            made = F.call_function("translate", c, row["letters"], row["made"])
            return F.when(i == last, p).when(made != c, F.concat(F.left(p, F.length(p) - 1), made)).otherwise(
                F.concat(p, row["mark"]))
        parts = let(F.split(t, row["mark"], -1), lambda ps: F.array_join(
            F.transform(ps, lambda p, i: end(p, i, F.size(ps) - 1)), ""))
        return F.when(F.contains(t, row["mark"]), parts).otherwise(t)

    return F.when(text.rlike(r"\p{M}"), F.aggregate(table, text, join)).otherwise(text)


def semantic_norm(col: Column | str) -> Column:
    return F.regexp_replace(F.lower(compose(col)), r"[^\p{L}\p{N}_\s']", " ")


def semantic_words(col: Column | str) -> Column:
    """The words of :func:`semantic_norm`, read in one pass: what it turns into blanks, and white space, lies between them."""
    # plain letters come first, as each alternative of the class is asked in turn
    return F.regexp_extract_all(F.lower(compose(col)), F.lit(r"[a-z0-9\p{L}\p{N}_']+"), F.lit(0))


def token_set(col: Column | str) -> Column:
    found = F.regexp_extract_all(F.lower(text_or_empty(col)), F.lit("[a-zğüşıöç]+"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, fixed.MEDIA_STOPWORDS)))


def keyphrases(col: Column | str, fragments: int = 14, longest: int = 6, most: int = 10) -> Column:
    """Theme text to search phrases: fragments without stop words, at least two words each."""
    parts = F.slice(F.filter(F.transform(F.split(text_or_empty(col), r"[.,;:\n]"), strip),
                             lambda p: p != ""), 1, fragments)
    words = F.transform(parts, lambda p: F.slice(F.filter(
        F.regexp_extract_all(F.lower(p), F.lit("[a-zA-Z']+"), F.lit(0)),
        lambda w: ~w.isin(fixed.THEME_STOPWORDS)), 1, longest))
    kept = F.filter(words, lambda w: F.size(w) >= 2)
    return F.slice(F.array_distinct(F.transform(kept, lambda w: F.array_join(w, " "))), 1, most)


def normalize_hashtags(tags: Column | str, artist: Column | str, most: int = 30) -> Column:
    """``#`` in front, empty tags out, the artist's tag second when it is missing."""
    cleaned = F.filter(F.transform(_c(tags), lambda t: F.trim(t)),
                       lambda t: F.regexp_replace(t, "^#+|#+$", "") != "")
    cleaned = F.transform(cleaned, lambda t: F.when(t.startswith("#"), t).otherwise(
        F.concat(F.lit("#"), t)))
    name = text_or_empty(artist)
    mine = F.concat(F.lit("#"), F.regexp_replace(name, "[^A-Za-z0-9]", ""))
    missing = (name != "") & ~F.array_contains(F.transform(cleaned, F.lower), F.lower(mine))
    head, tail = F.slice(cleaned, 1, 1), F.slice(cleaned, 2, most)
    return F.slice(F.when(missing, F.concat(head, F.array(mine), tail)).otherwise(cleaned), 1, most)


def strip_hashtag_lines(body: Column | str) -> Column:
    kept = F.filter(F.split(text_or_empty(body), r"\R"), lambda x: ~F.trim(x).startswith("#"))
    return strip(F.replace(F.array_join(kept, "\n"), F.lit("*"), F.lit("")))


def caption_template(title: Column | str, artist: Column | str) -> Column:
    """Struct (title, caption, hashtags) from fixed wording."""
    song = F.when(F.coalesce(_c(title), F.lit("")) == "", F.lit("Bu eser")).otherwise(_c(title))
    who = text_or_empty(artist)

    def tag(c: Column) -> Column:
        return F.concat(F.lit("#"), F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))

    caption = F.concat(F.lit(fixed.CAPTION_LEAD + "\n\n"), song, F.lit(fixed.CAPTION_BODY),
                       F.lit("\n\n🎵 "), song)
    tags = F.concat(F.array(tag(song)), F.when(who != "", F.array(tag(who))).otherwise(
        F.array().cast("array<string>")), F.array(*map(F.lit, fixed.CAPTION_TAGS)))
    return F.struct(
        F.left(F.concat_ws(" — ", song, F.nullif(who, F.lit(""))), F.lit(90)).alias("title"),
        caption.alias("caption"), tags.alias("hashtags"))


def append_mention(body: Column | str, handle: Column | str) -> Column:
    at = F.concat(F.lit("@"), F.trim(F.regexp_replace(F.trim(text_or_empty(handle)), "^@+", "")))
    b = text_or_empty(body)
    add = (F.trim(text_or_empty(handle)) != "") & ~F.contains(F.lower(b), F.lower(at))
    return F.when(add, F.concat(F.regexp_replace(b, r"(?U)\s+$", ""), F.lit("\n🎤 "), at)).otherwise(b)


def publish_metadata(title: Column | str, description: Column | str, tags: Column | str) -> Column:
    t = _c(title)
    return F.struct(
        F.left(F.when(text_or_empty(t) == "", F.lit("Untitled")).otherwise(t), F.lit(100))
        .alias("title"),
        F.left(text_or_empty(description), F.lit(4900)).alias("description"),
        F.slice(F.filter(F.transform(F.coalesce(_c(tags), F.array().cast("array<string>")), strip),
                         lambda x: x != ""), 1, 30).alias("tags"))


def rotate_queries(own: Column, theme: Column, idx: Column, song: Column, most: int = 5) -> Column:
    """Search phrases of a scene: own ones with the rotated theme at slot 2, else the theme; topped
    up from the song's phrases."""
    n = F.size(theme)
    at = F.when(n > 0, idx % F.when(n > 0, n).otherwise(1)).otherwise(0).cast("int")
    rotated = F.concat(F.slice(theme, at + 1, F.greatest(n, F.lit(1))),
                       F.slice(theme, F.lit(1), at))
    mixed = F.concat(F.slice(own, 1, 1), F.slice(rotated, 1, 1), F.slice(own, F.lit(2), F.greatest(F.size(own), F.lit(1))),
                     F.slice(rotated, 2, 1))
    start = F.when(n == 0, own).when(F.size(own) > 0, mixed).otherwise(F.slice(rotated, 1, 3))

    def top_up(s: Column) -> Column:
        fill = F.array_distinct(F.filter(song, lambda q: ~F.array_contains(s, q)))
        return F.concat(s, F.slice(fill, F.lit(1), F.greatest(F.lit(0), F.lit(most) - F.size(s))))

    return let(start, top_up)


def cyclic_pick(idx: Column, values: Sequence[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (idx % len(values) + 1).cast("int"))


def hashed_pick(cols: Sequence[Column | str], n: int) -> Column:
    """Repeatable choice of 0..n-1 from the given columns: the first 8 hex digits of the MD5 of their values, joined
    by a bar, modulo n. Null values are left out."""
    digits = F.substring(F.md5(F.concat_ws("|", *[_c(c).cast("string") for c in cols])), 1, 8)
    return (F.conv(digits, 16, 10).cast("long") % n).cast("int")


def wrap_text(col: Column | str, max_width: int) -> Column:
    """Greedy wrap at ``max_width`` characters; an over-long word is broken with a hyphen.

    One fold over the words: full lines are glued into one string with line breaks, so the state
    stays two strings however long the text is.
    """
    width = F.lit(max_width)

    def place(acc: Column, word: Column) -> Column:
        joined = F.when(acc["cur"] == "", word).otherwise(F.concat(acc["cur"], F.lit(" "), word))
        full = (acc["cur"] != "") & (F.length(joined) > width)
        return F.struct(
            F.when(full, F.concat(acc["done"], acc["cur"], F.lit("\n"))).otherwise(acc["done"])
            .alias("done"),
            F.when(full, word).otherwise(joined).alias("cur"))

    def cut(acc: Column) -> Column:
        # all but the last piece of an over-long word become lines of width - 1 plus a hyphen; a
        # piece is closed only when one more letter and the hyphen would not fit
        cur, step = acc["cur"], max(1, max_width - 1)
        n = F.length(cur)
        pieces = F.ceil(n / F.lit(step)).cast("int")
        over = n > width
        lead = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), pieces - 1)), lambda i: F.concat(
            F.substring(cur, (i - 1) * step + 1, F.lit(step)), F.lit("-\n")))
        return F.struct(
            F.when(over, F.concat(acc["done"], F.array_join(lead, ""))).otherwise(acc["done"])
            .alias("done"),
            F.when(over, F.substring(cur, (pieces - 1) * step + 1, F.lit(step))).otherwise(cur)
            .alias("cur"))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("cur"))
    out = F.aggregate(words_of(col), start, lambda acc, w: cut(place(acc, w)),
                      lambda acc: F.concat(acc["done"], acc["cur"]))
    return F.filter(F.split(out, "\n"), lambda x: x != "")


def text_width(col: Column, widths: dict[str, int], default: int) -> Column:
    """Width of a string: the sum of its characters' widths, ``default`` for those not named."""
    table = F.create_map(*[x for c, w in widths.items() for x in (F.lit(c), F.lit(int(w)))])
    chars = F.filter(F.split(col, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda n, c: n + (
        F.coalesce(F.try_element_at(table, c), F.lit(int(default))) if widths else F.lit(int(default))))


def wrap_measured(col: Column | str, max_width: int, widths: dict[str, int], default: int = 1) -> Column:
    """Greedy wrap at ``max_width`` by the caller's measure: a width for each character, ``default`` for others.

    No line is wider, unless one character with its hyphen is: an over-long word is broken, each piece as long as it can
    be with a hyphen after it. Every word is measured once; the fold over the words carries the width of the open line.
    """
    width = F.lit(int(max_width))
    space, hyphen = (F.lit(int(widths.get(c, default))) for c in (" ", "-"))
    words = F.transform(words_of(col), lambda w: F.struct(w.alias("w"), text_width(w, widths, default).alias("n")))

    def broken(word: Column) -> Column:
        """Pieces of an over-long word: ``done`` (each with its hyphen and line break), the last one, and its width."""
        def step(a: Column, ch: Column) -> Column:
            n = text_width(ch, widths, default)
            full = (a["cur"] != "") & (a["n"] + n + hyphen > width)
            return F.struct(F.when(full, F.concat(a["done"], a["cur"], F.lit("-\n"))).otherwise(a["done"]).alias("done"),
                            F.when(full, ch).otherwise(F.concat(a["cur"], ch)).alias("cur"),
                            F.when(full, n).otherwise(a["n"] + n).alias("n"))
        chars = F.filter(F.split(word, ""), lambda c: c != "")
        return F.aggregate(chars, start, step)

    def place(acc: Column, word: Column) -> Column:
        fits = (acc["cur"] != "") & (acc["n"] + space + word["n"] <= width)
        ended = F.when((acc["cur"] != "") & ~fits, F.concat(acc["done"], acc["cur"], F.lit("\n"))).otherwise(acc["done"])
        over = word["n"] > width
        parts = F.when(over, broken(word["w"]))
        return F.struct(
            F.when(over, F.concat(ended, parts["done"])).otherwise(ended).alias("done"),
            F.when(over, parts["cur"]).when(fits, F.concat(acc["cur"], F.lit(" "), word["w"])).otherwise(word["w"]).alias("cur"),
            F.when(over, parts["n"]).when(fits, acc["n"] + space + word["n"]).otherwise(word["n"]).alias("n"))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))
    out = F.aggregate(words, start, place, lambda acc: F.concat(acc["done"], acc["cur"]))
    return F.filter(F.split(out, "\n"), lambda x: x != "")


def block_size(lines: Column, line_height: int, gap: int = 8, char_width: int = 1) -> Column:
    n = F.size(lines)
    return F.struct(
        F.when(n > 0, F.array_max(F.transform(lines, F.length)) * char_width).otherwise(0).alias("w"),
        F.when(n > 0, n * line_height + (n - 1) * gap).otherwise(0).alias("h"))


def expand_queries(df: DataFrame, key: Sequence[str], artist: str = "artist", title: str = "title",
                   duration: str = "duration") -> DataFrame:
    """Lookup queries of a request, in order: exact pairs (when the length is known), then searches."""
    a0, t0 = text_or_empty(artist), text_or_empty(title)
    parsed = split_artist_title(title)
    ca0, ct0 = clean_track_name(artist), clean_track_name(title)
    use = (ca0 == "") & (parsed["artist"] != "") & (parsed["title"] != "")
    ca = F.when(use, clean_track_name(parsed["artist"])).otherwise(ca0)
    ct = F.when(use, clean_track_name(parsed["title"])).otherwise(ct0)
    known = F.coalesce(F.col(duration), F.lit(0.0)) != 0

    def row(kind: str, ok: Column, a: Column, t: Column, q: Column) -> Column:
        return F.when(ok, F.struct(F.lit(kind).alias("kind"), a.alias("artist"), t.alias("title"),
                                   q.alias("query")))

    none = F.lit(None).cast("string")
    exact = F.filter(F.array(
        row("exact", known & (ca != "") & (ct != ""), ca, ct, none),
        row("exact", known & (a0 != "") & (t0 != ""), a0, t0, none)), lambda r: r.isNotNull())
    qs = F.filter(F.array(F.trim(F.concat_ws(" ", F.nullif(ca, F.lit("")), ct)), ct,
                          F.trim(F.concat_ws(" ", F.nullif(a0, F.lit("")), F.nullif(t0, F.lit(""))))),
                  lambda q: q != "")
    lowered = F.transform(qs, F.lower)
    first = F.filter(F.transform(qs, lambda q, i: F.when(
        F.array_position(lowered, F.lower(q)) == i + 1, q)), lambda q: q.isNotNull())
    search = F.transform(first, lambda q: F.struct(
        F.lit("search").alias("kind"), none.alias("artist"), none.alias("title"), q.alias("query")))
    return positions(df, key, F.concat(exact, search), "query_index", "q").select(
        *key, "query_index", "q.*")


def assemble_prompt(df: DataFrame, style: str = "style", variant: str = "variant",
                    theme: str = "theme", avoid: str = "avoid") -> DataFrame:
    """Description text of a scene: phrase, mood, view, style template, theme, avoided terms."""
    def lookup(values: dict[str, str], col: Column, default: str) -> Column:
        out = None
        for k, v in values.items():
            out = F.when(col == k, v) if out is None else out.when(col == k, v)
        return out.otherwise(values[default])

    key = F.when(F.col(style) == "doodle", "storybook").otherwise(F.col(style))
    queries = F.when(F.size(F.coalesce(F.col("queries"), F.array().cast("array<string>"))) > 0,
                     F.col("queries")).otherwise(F.array(F.lit("cinematic scenery")))
    v = F.coalesce(F.col(variant), F.lit(0))
    photo = ~key.isin([k for k in fixed.ART_STYLES if k != "photo"])
    lyric, emotion = text_or_empty("lyric"), text_or_empty("emotion")
    terms = F.filter(F.transform(F.split(text_or_empty(avoid), ","), strip), lambda x: x != "")
    note = strip(text_or_empty(theme))
    template = F.replace(lookup(fixed.ART_STYLES, key, "photo"), F.lit("{palette}"),
                         lookup(fixed.MOOD_PALETTES, emotion, "neutral"))
    return df.withColumn("prompt", F.concat_ws(
        ", ",
        F.element_at(queries, (v % F.size(queries) + 1).cast("int")),
        F.when((lyric != "") & photo, F.concat(F.lit('inspired by the lyric "'),
                                               F.left(lyric, F.lit(80)), F.lit('"'))),
        F.when((emotion != "") & (emotion != "neutral"), F.concat(emotion, F.lit(" mood"))),
        F.when(v > 0, cyclic_pick(v, fixed.VIEWS)),
        template,
        F.when(note != "", F.concat(F.lit("subtle "), F.left(note, F.lit(100)), F.lit(" undertone"))),
        F.lit(fixed.NO_TEXT),
        F.when(F.size(terms) > 0, F.array_join(F.transform(F.slice(terms, 1, 10), lambda t: F.concat(
            F.lit("no "), t)), ", ")),
        F.when(F.size(terms) > 0, F.concat(F.lit("without "),
                                           F.array_join(F.slice(terms, 1, 6), " or ")))))


def dominant(names: Sequence[str]) -> Column:
    """Name of the largest of the given columns; the first wins a tie, ``neutral`` when all are 0."""
    top = F.greatest(*[F.coalesce(F.col(n), F.lit(0.0)) for n in names])
    out = None
    for n in names:
        hit = F.coalesce(F.col(n), F.lit(0.0)) == top
        out = F.when(hit, n) if out is None else out.when(hit, n)
    zero = F.lit(True)
    for n in names:
        zero = zero & (F.coalesce(F.col(n), F.lit(0.0)) == 0)
    return F.when(zero, "neutral").otherwise(out)


def ordered_union(*cols: Column) -> Column:
    return F.array_distinct(F.concat(*cols))


def ordered_except(a: Column, b: Column) -> Column:
    """What is in ``a`` but not in ``b``, repeats kept."""
    return let(b, lambda known: F.filter(a, lambda x: ~F.array_contains(known, x)))


def display_text(corrected: str = "corrected_text", text: str = "text") -> Column:
    return F.coalesce(F.col(corrected), F.col(text))
