"""Quality rules as a short-circuit cascade of DataFrame expressions, ordered by rejections per cost on a sample.

Base measures are those of the contract; the base rule rejects texts that are too short or repeat themselves. Every
further rule names the measures it needs and when it rejects. On a bounded sample the planner times each rule's own
measures and counts its rejections, sorts by rejections per second, and writes the rules as one ``CASE``: a row leaves
at its first rejection, and later rules' measures are never computed for it. The order changes the cost of a verdict,
never the verdict, so runs agree although timings do not.

The sample is SAMPLE_ROWS whole texts of at most SAMPLE_CHARS characters, drawn by a hash from the first input splits that
hold so many; splits beyond them are not read for it and nothing is shuffled. A rule's time is the median of three runs
over REPEATS copies of the sample, less the time of a run without any rule.

All work per row is done by built-in functions on one document; there is no shuffle, so hot sources and very long
documents are rows like any other. Repeated windows are found by sorting the document's window hashes, and only if some
hash repeats at all; windows are held equal if their 64-bit hashes are, which errs once in about 10^9 texts of 10^5 words.

Edge cases: null or blank text has measures 0 and fails the base rule; repeated rows are judged each; columns that
clash with a measure's name are not read and do not pass on, except doc_id; ``keep`` passes columns of any name; an empty
table gives no rows.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.llm.words import let, window_hashes, word_array
from lodeline.storage import settle

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which rules are timed, their length at most, one row in so many is drawn, and copies of it per run.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_ONE_IN, REPEATS = 300, 50_000, 16, 4


def _text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _kept_chars(text: Column, others: str) -> Column:
    """Number of characters left when runs of ``others`` are removed."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def word_chars(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w))


def n_symbols(text: Column) -> Column:
    return _kept_chars(text, f"[^{SYMBOLS}]+")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(words: Column) -> Column:
    """Words inside eight-word windows that occur twice or more, the first occurrence included."""
    def covered(h: Column) -> Column:
        marked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        again = let(marked, lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])))
        starts = F.array_sort(F.transform(again, lambda x: x["p"]))
        # the union of windows of eight: each adds its distance to the next start, eight at most
        steps = let(starts, lambda p: F.aggregate(F.zip_with(F.slice(p, 2, F.greatest(F.lit(0), F.size(p) - 1)), p, lambda b, a: F.coalesce(F.least(F.lit(WINDOW), b - a), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x))
        return steps.cast("long")

    repeated = let(window_hashes(words, WINDOW), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > WINDOW, repeated).otherwise(F.lit(0).cast("long"))


@dataclass(frozen=True)
class Rule:
    """``rejects(text, n_words)`` is true for rows to leave out; ``text`` is never null."""

    name: str
    rejects: object


def _letters(text: Column) -> Column:
    return _kept_chars(text, "[^\\p{L}]+")


def echoes(text: Column) -> Column:
    """Words equal to the one before them."""
    return let(word_array(text), lambda w: F.size(F.filter(F.zip_with(w, F.slice(w, 2, F.size(w)), lambda x, y: x == y), lambda same: same)).cast("long"))


RULES = (
    Rule("symbols", lambda text, n: n_symbols(text) * 10 > n * 3),
    Rule("shouting", lambda text, n: let(_kept_chars(text, "[^\\p{Lu}]+"), lambda up: (up > 20) & (up * 2 > _letters(text)))),
    Rule("exclamations", lambda text, n: _kept_chars(text, "[^!]+") * 3 > n),
    Rule("word_length", lambda text, n: let(_kept_chars(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda c: (c < n * 2) | (c > n * 14))),
    Rule("repeated_lines", lambda text, n: let(n_dup_lines(text), lambda d: (d >= 4) & (d * 10 > F.size(F.split(text, "\n")) * 6))),
    Rule("echoes", lambda text, n: echoes(text) * 5 > n),
)


def _sample(docs: DataFrame) -> DataFrame:
    text = _text(docs["text"])
    drawn = (F.pmod(F.xxhash64(text, F.lit(7)), F.lit(SAMPLE_ONE_IN)) == 0) & (F.length(text) <= SAMPLE_CHARS)
    rows = docs.select(text.alias("text")).filter(drawn).take(SAMPLE_ROWS)
    return docs.sparkSession.createDataFrame([(r.text,) for r in rows], "text string").coalesce(1)


def plan_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, float, float]]:
    """``rules`` by rejections per second of their own cost, with seconds and rejected share on the sample."""
    sample = settle(_sample(docs).withColumn("words", F.size(word_array(F.col("text"))).cast("long")), "sample")
    copies = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def run(reject: Column) -> tuple[float, int, int]:
        asked, seconds, row = copies.agg(F.count("*").alias("rows"), F.count_if(reject).alias("hit")), [], None
        for _ in range(3):
            began = time.perf_counter()
            row = asked.first()
            seconds.append(time.perf_counter() - began)
        return median(seconds), row.hit, row.rows

    run(F.lit(False))
    idle = run(F.lit(False))[0]
    measured = []
    for rule in rules:
        seconds, hit, n = run(rule.rejects(F.col("text"), F.col("words")))
        measured.append((rule, max(seconds - idle, 1e-3), hit / n if n else 0.0))
    return sorted(measured, key=lambda m: -m[2] / m[1])


def first_rejection(text: Column, n_words: Column, rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, else null; rules after it are not computed."""
    if not rules:
        return F.lit(None).cast("string")
    case = F.when(rules[0].rejects(text, n_words), rules[0].name)
    for rule in rules[1:]:
        case = case.when(rule.rejects(text, n_words), rule.name)
    return case


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, n_words, base measures, base_failed, kept."""
    order = [m[0] for m in plan_order(docs, rules)]
    rows = docs.select("doc_id", _text(F.col("text")).alias("text")).withColumn("words", word_array(F.col("text")))
    rows = rows.select(
        "doc_id", "text", F.size("words").cast("long").alias("n_words"), word_chars(F.col("words")).alias("word_chars"),
        n_symbols(F.col("text")).alias("n_symbols"), n_dup_lines(F.col("text")).alias("n_dup_lines"), n_repeat_words(F.col("words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    rows = rows.withColumn("base_failed", failed)
    kept = F.when(F.col("base_failed"), False).otherwise(first_rejection(F.col("text"), F.col("n_words"), order).isNull())
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    order = [m[0] for m in plan_order(docs, rules)]
    words = word_array(F.col("text").cast("string"))
    base = let(words, lambda w: (F.size(w) >= MIN_WORDS) & (n_repeat_words(w) * 100 <= F.size(w) * MAX_REPEAT_PERCENT))
    n = F.size(words).cast("long")
    return docs.filter(F.when(~base, False).otherwise(first_rejection(_text(F.col("text")), n, order).isNull()))
