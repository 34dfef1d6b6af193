"""Secret scans: known shapes, and sliding-window entropy over candidate strings.

Three shapes are found by pattern. Beside them every run of 20 or more token characters that mixes letters and
digits is a candidate; its character class (hex, letters and digits of one case or of both, base64) sets the entropy that
counts as random. The Shannon entropy of a window slides along the candidate with a count for each of its characters: with
``c`` such a count, the sum of ``c log2 c`` changes only for the character that enters and the one that leaves.
Candidates on the allow list are not reported, and of others only what no span of a known shape covers. All of it is
JVM-side and inside the row: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a longest run from its first AKIA, so the bound can stand in the pattern
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Entropy in bits that a window must reach, by character class.
LEAST_BITS = {"hex": 3.0, "alnum": 3.6, "one_case": 3.7, "base64": 3.8}
#: Candidates that are no secrets: identifiers, paths and words joined by separators, placeholders.
ALLOWED = (r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
           r"^[0-9_/=+-]+$",
           r"^/?([A-Za-z]+|[0-9]{1,4})([-_/=+]([A-Za-z]+|[0-9]{1,4}))+/?$",
           r"(?i)example|placeholder|changeme|xxxx")


def _spans(text: Column, pattern: str, found: Column, ok, rank: int) -> Column:
    """Spans (start, rank, end) of the matches that pass ``ok``, in code points.

    ``found``: all matches. What lies between them comes from a split by the same pattern.
    """
    gaps = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    pairs = F.arrays_zip(found.alias("m"), F.transform(gaps, lambda g: F.char_length(g)).alias("g"))
    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(a, p):
        start = a["at"] + p["g"]
        end = start + F.char_length(p["m"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(ok(p["m"]), F.array_append(a["out"], span)).otherwise(
            a["out"]).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(
        F.filter(pairs, lambda p: p["m"].isNotNull()), begin, step, lambda a: a["out"])).otherwise(none)


def window_entropy(text: Column, width: int = WINDOW) -> Column:
    """The largest entropy (bits) of any ``width`` neighbouring characters; of the whole if it is shorter."""
    def weight(k):  # k log2 k
        return F.when(k > 0, k * F.log2(k.cast("double"))).otherwise(F.lit(0.0))

    def slide(x):
        codes, n = x["codes"], F.size(x["codes"])
        width_here = F.least(F.lit(width), n)

        def step(a, i):
            new, old = F.get(codes, i - 1), F.when(i > width, F.get(codes, i - width - 1))
            up, down = F.get(a["n"], new), F.get(a["n"], old)
            # one of the leaving character less, one of the entering character more; the same one changes nothing
            moved = F.when(new == old, F.lit(0.0)).otherwise(
                weight(up + 1) - weight(up) - F.coalesce(weight(down) - weight(down - 1), F.lit(0.0)))
            counts = F.transform(a["n"], lambda c, k: c + (k == new).cast("int") - F.coalesce((k == old).cast("int"), F.lit(0)))
            s = a["s"] + moved
            bits = F.when(i >= width_here, F.log2(width_here.cast("double")) - s / width_here).otherwise(F.lit(0.0))
            return F.struct(s.alias("s"), F.greatest(a["best"], bits).alias("best"), counts.alias("n"))

        start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("best"), F.array_repeat(F.lit(0), x["kinds"]).alias("n"))
        return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda a: a["best"])

    def coded(chars):
        kinds = F.array_distinct(chars)
        return F.struct(F.transform(chars, lambda c: (F.array_position(kinds, c) - 1).cast("int")).alias("codes"),
                        F.size(kinds).alias("kinds"))

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    once = lambda x, use: F.element_at(F.transform(F.array(x), use), 1)
    return F.round(once(once(chars, coded), slide), 9)


def is_secret(candidate: Column, least: dict[str, float] | None = None) -> Column:
    """Whether a candidate is random enough for its class and not on the allow list."""
    least = least or LEAST_BITS
    hexa = F.rlike(candidate, F.lit(r"^([0-9a-f]+|[0-9A-F]+)$"))
    alnum = F.rlike(candidate, F.lit(r"^[A-Za-z0-9]+$"))
    both = F.rlike(candidate, F.lit(r"[a-z]")) & F.rlike(candidate, F.lit(r"[A-Z]"))
    # letters of one case need digits in two places: a word with a number at its end is no token
    single = F.rlike(candidate, F.lit(r"[0-9][^0-9]*[A-Za-z][^0-9]*[0-9]"))
    mixed = F.rlike(candidate, F.lit(r"[0-9]")) & F.when(hexa, F.rlike(candidate, F.lit(r"[A-Fa-f]"))).otherwise(both | single)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | F.rlike(candidate, F.lit(pattern))
    bits = F.when(hexa, F.lit(least["hex"])).when(alnum & both, F.lit(least["alnum"])).when(
        alnum, F.lit(least["one_case"])).otherwise(F.lit(least["base64"]))
    return F.when(mixed & ~allowed, window_entropy(candidate) >= bits).otherwise(False)


def _uncovered(span, others: Column) -> Column:
    """What sorted other spans leave of a span, as spans of its rank."""
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")

    def piece(a, end):
        new = F.struct(a["at"].alias("start"), span["rank"].alias("rank"), end.alias("end"))
        return F.when(end > a["at"], F.array_append(a["out"], new)).otherwise(a["out"])

    def step(a, b):
        return F.struct(F.greatest(a["at"], b["end"]).alias("at"), piece(a, b["start"]).alias("out"))

    near = F.filter(others, lambda b: (b["start"] < span["end"]) & (b["end"] > span["start"]))
    begin = F.struct(span["start"].alias("at"), none.alias("out"))
    return F.aggregate(near, begin, step, lambda a: piece(a, span["end"]))


def scan(docs: DataFrame, least: dict[str, float] | None = None) -> DataFrame:
    """Rows of ``docs`` with ``base_spans`` and ``spans``: arrays of (start, rank, end) in code points, sorted.

    ``rank`` numbers KINDS; ``base_spans`` has the three shapes, ``spans`` also the entropy spans. Null texts are
    empty and have no spans; very long ones are scanned whole; repeated rows are scanned each; an empty table gives no rows. Columns of ``docs`` named
    ``base_spans`` or ``spans`` are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.drop("base_spans", "spans", "_assign", "_access", "_hex", "_cand", "_entropy").withColumns({
        "_assign": F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)),
        "_access": F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)),
        "_hex": F.regexp_extract_all(text, F.lit(HEX), F.lit(0)),
        "_cand": F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))})
    always = lambda m: F.lit(True)
    long_value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 8
    rows = rows.withColumn("base_spans", F.array_sort(F.concat(
        _spans(text, ASSIGN, F.col("_assign"), long_value, 0), _spans(text, ACCESS, F.col("_access"), always, 1),
        _spans(text, HEX, F.col("_hex"), always, 2))))
    rows = rows.withColumn("_entropy", _spans(text, CANDIDATE, F.col("_cand"), lambda m: is_secret(m, least), 3))
    apart = F.flatten(F.transform("_entropy", lambda e: _uncovered(e, F.col("base_spans"))))
    return rows.withColumn("spans", F.array_sort(F.concat("base_spans", apart))).drop(
        "_assign", "_access", "_hex", "_cand", "_entropy")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span (overlapping ones as one) replaced by a mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a, s):
        fresh = s["start"] >= a["at"]
        more = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("[SECRET]"))
        return F.struct(F.when(fresh, more).otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    def end(a):
        return F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(text)


def hide(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by a mark, and ``n_chars`` (if there is one) adjusted.

    Null texts stay null; all rows stay, and all other columns.
    """
    rows = scan(docs.select(F.struct("*").alias("_row"), "text"))
    found = F.size("spans") > 0
    rows = rows.withColumn("_clean", redact(F.col("text"), F.col("spans")))
    new = {"text": F.when(found, F.col("_clean")).otherwise(F.col("text")),
           "n_chars": F.when(found, F.char_length("_clean").cast("long")).otherwise(F.col("_row.n_chars"))
           if "n_chars" in docs.columns else None}
    return rows.select(*[(new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])
