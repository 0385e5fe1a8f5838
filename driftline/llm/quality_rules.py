"""Line-first cleaning: rules on lines, then a verdict on the document by how much text they took."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "[#*$%&|<>]"
SEPARATORS = "[|»•›·]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document stays while its failed lines hold at most this share of its words.
MAX_LOST_PERCENT = 50
#: A line with this many link separators, and few words to each, is navigation.
NAV_SEPARATORS = 3
NAV_WORDS_EACH = 2
#: A line fails for symbols when it has more than one to every two words.
MAX_SYMBOLS_PER_WORD = 0.5
# Phrases of page furniture.
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "lorem ipsum", "click here", "sign up for our newsletter", "skip to content")
#: One word of each phrase: a text with none of them has no phrase.
BOILERPLATE_WORDS = ("rights", "policy", "terms", "javascript", "ipsum", "click", "newsletter", "skip")
#: Bits of a place in the numbers that windows are sorted by.
PLACE_BITS = 20


def _count(text: Column, characters: str) -> Column:
    """How many characters of a regular expression's class are in a text."""
    return F.regexp_count(text, F.lit(characters))


def _words(line: Column) -> Column:
    """The words of a line whose white space is spaces."""
    return F.array_remove(F.split(line, " "), "")


def _spaced(text: Column) -> Column:
    """The text with spaces for all white space but line feeds: these literal replacements are cheaper than a pattern."""
    for c in "\t\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def line_fails(line: Column, words: Column, phrases: bool = True, marks: bool = True) -> Column:
    """Whether a line is furniture: navigation, boilerplate, symbol noise, or a short line that no punctuation ends.

    A text without a word of the phrases, or without symbols and enough separators, does not need those rules.
    """
    bad = (words <= 3) & ~line.rlike("[.!?:;,\"')\\]…。！？”»][\\x20\\x09-\\x0D]*\\z")
    if marks:
        separators = _count(line, SEPARATORS)
        bad = bad | (_count(line, SYMBOLS) > words * F.lit(MAX_SYMBOLS_PER_WORD)) | ((separators >= NAV_SEPARATORS) & (words <= NAV_WORDS_EACH * (separators + 1)))
    if phrases:
        bad = bad | F.lower(line).rlike("|".join(BOILERPLATE).replace(" ", r"\s+"))
    return (words > 0) & bad


def _repeated(step: DataFrame, others: list[str]) -> DataFrame:
    """`_at` for `_h`, the hashes of a text's windows: the places of those found twice or more, ascending.

    Plain longs sort fastest: PLACE_BITS of place below the rest of the hash. Where two hashes agree in that rest
    alone, and in texts with more windows than places, whole hashes are sorted with their places instead.
    """
    mask = (1 << PLACE_BITS) - 1
    near = lambda x, y: F.shiftrightunsigned(x.bitwiseXOR(y), PLACE_BITS) == 0
    place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    step = step.select(*others, "_h", F.sort_array(F.transform("_h", lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long")))).alias("_s"))
    step = step.select(*others, "_h", F.filter("_s", lambda x, i: near(x, F.get("_s", i + 1)) | near(x, F.get("_s", i - 1))).alias("_c"))
    whole = F.size(F.array_distinct(F.transform("_c", lambda x: F.get("_h", place(x)))))
    part = F.size(F.array_distinct(F.transform("_c", lambda x: F.shiftrightunsigned(x, PLACE_BITS))))
    step = step.select(*others, "_c", F.when((whole != part) | (F.size("_h") > mask), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_e"))
    same = lambda x, j: x["h"] == F.get("_e", j)["h"]
    exact = F.transform(F.filter("_e", lambda x, i: same(x, i + 1) | same(x, i - 1)), lambda x: x["i"])
    return step.select(*others, F.sort_array(F.coalesce(exact, F.transform("_c", place))).alias("_at"))


def quality_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds to every row of `docs` the features, `clean_text`, `lost_words`, `base_failed` and `kept`.

    Lines that break a rule are removed first: navigation bars, boilerplate phrases, symbol noise, and lines of at
    most three words without closing punctuation. Then the document is rejected when those lines held more than
    half of its words. Before that, documents of under 50 words, or with over half of their words in repeated
    three-word windows, fail as a whole.

    Null and empty texts have no words, fail the base rule and give clean_text ''. Rows never mix, so ties and
    repeated rows are judged alike; an empty table stays empty. Input columns named like an output are replaced.
    """
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "clean_text", "base_failed", "kept"]
    others = [c for c in docs.columns if c.lower() not in out or c == text_col]
    step = docs.select(*others, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    step = step.select(*others, "_t", F.split("_t", "\n").alias("_l"), F.transform(F.split(_spaced(F.col("_t")), "\n"), _words).alias("_lw"))
    step = step.select(*others, "_t", "_l", "_lw", F.flatten("_lw").alias("_w"))
    symbols, separators, lower = _count(F.col("_t"), SYMBOLS), _count(F.col("_t"), SEPARATORS), F.lower("_t")
    boiler = F.lit(False)
    for word in BOILERPLATE_WORDS:
        boiler = boiler | lower.contains(word)
    step = step.select(
        *others, "_l", "_lw", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"), ((separators >= NAV_SEPARATORS) | (symbols > 0)).alias("_marked"), boiler.alias("_boiler"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_wh"),
    )
    done = [*others, "n_words", "word_chars", "n_symbols", "_marked", "_boiler"]
    windows = F.transform(F.slice("_wh", 1, F.greatest(F.size("_wh") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("_wh", i + 1), F.get("_wh", i + 2)))
    step = _repeated(step.select(*done, "_l", "_lw", windows.alias("_h")), [*done, "_l", "_lw"])
    # each window covers three words, less those that the one before it covers
    covered = F.aggregate(
        "_at", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"]
    )
    judged = lambda **rules: F.zip_with("_l", "_lw", lambda x, ws: F.struct(x.alias("line"), F.size(ws).alias("n"), line_fails(x, F.size(ws), **rules).alias("bad")))
    lines = F.when(F.col("_boiler"), judged()).when(F.col("_marked"), judged(phrases=False)).otherwise(judged(phrases=False, marks=False))
    full = F.filter("_l", lambda x, i: F.size(F.get("_lw", i)) > 0)
    step = step.select(*done, covered.alias("n_repeat_words"), full.alias("_full"), lines.alias("_j"))
    lost = F.aggregate("_j", F.lit(0), lambda a, x: a + F.when(x["bad"], x["n"]).otherwise(0)).cast("long")
    step = step.select(
        *others, "n_words", "word_chars", "n_symbols", (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"), "n_repeat_words", lost.alias("lost_words"),
        F.array_join(F.transform(F.filter("_j", lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return step.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("lost_words") <= MAX_LOST_PERCENT * F.col("n_words")))


def drop_bad(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with their own columns, that `quality_rules` keeps.

    A row number stands between the verdict and the filter: without it the optimizer would put the filter below the
    projections and write the verdict's expressions out again for each use.
    """
    judged = quality_rules(docs.select("*", docs[text_col].alias("_judged")), "_judged")
    clash = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "clean_text", "base_failed", "kept"} & {c.lower() for c in docs.columns}
    if clash:
        packed = docs.select(F.struct("*").alias("_row"), docs[text_col].alias("_judged"))
        judged = quality_rules(packed, "_judged").select("_row", "kept")
        return judged.withColumn("_at", F.monotonically_increasing_id()).where("kept and _at >= 0").select("_row.*")
    return judged.select(*docs.columns, "kept").withColumn("_at", F.monotonically_increasing_id()).where("kept and _at >= 0").select(*docs.columns)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
grams AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
          FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)),
covered AS (SELECT rid, unnest([i, i + 1, i + 2]) AS j
            FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM grams) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM covered GROUP BY rid),
lines AS (SELECT rid, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
          FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)),
judged AS (SELECT rid, line, n,
   (length(line) - length(translate(line, '|»•›·', '')) >= 3 AND n <= 2 * (length(line) - length(translate(line, '|»•›·', '')) + 1))
   OR regexp_matches(lower(line), 'all\s+rights\s+reserved|cookie\s+policy|privacy\s+policy|terms\s+of\s+use|terms\s+of\s+service|enable\s+javascript|lorem\s+ipsum|click\s+here|sign\s+up\s+for\s+our\s+newsletter|skip\s+to\s+content')
   OR length(line) - length(translate(line, '#*$%&|<>', '')) > n * 0.5
   OR (n <= 3 AND NOT regexp_matches(regexp_replace(line, '[\x20\x09-\x0D]+$', ''), '[.!?:;,"'')\]…。！？”»]$')) AS bad
   FROM lines WHERE n > 0),
per_line AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(n) FILTER (WHERE bad), 0) AS lost FROM judged GROUP BY rid),
f AS (SELECT w.rid, doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
      FROM w LEFT JOIN rep USING (rid) LEFT JOIN per_line USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 50 * n_words AS kept
FROM f
"""
