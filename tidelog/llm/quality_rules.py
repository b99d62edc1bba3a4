"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

signals() computes lengths, symbols, stop words and line ratios of each text in the JVM; compile_rules() turns the table into one
boolean column. Nothing is shuffled and no user function runs.

Defined cases: null and white-space-only texts have no words and fail the length rule; signal columns replace input columns of
the same name; all other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for with as on it at by from be are was this or an not have has but you we they he she "
    "der die das und von zu den mit ist nicht ein eine im auf für sich des dem als auch es "
    "le la les et de du des un une est que qui dans pour par sur en au aux ne pas ce il "
    "el los las y se del por con una para lo su al como más o"
).split()
STOP_FORMS = sorted({f for w in STOP_WORDS for f in (w, w.capitalize())})
#: Up to so many distinct repeated windows are looked up one by one.
FEW = 48


@dataclass(frozen=True)
class Rule:
    """Holds if low <= value <= high; value is an expression over the signals."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None


#: Ratios are written as products so that no document divides by zero.
RULES = (
    Rule("long_enough", "n_words", low=50),
    Rule("few_repeats", "100 * n_repeat_words - 50 * n_words", high=0),
    Rule("few_symbols", "100 * n_symbols - 25 * n_words", high=0),
    Rule("has_stop_words", "100 * n_stop_words - 6 * n_words", low=0),
    Rule("few_duplicate_lines", "100 * n_dup_lines - 40 * n_lines", high=0),
    Rule("words_not_short", "word_chars - 2 * n_words", low=0),
    Rule("words_not_long", "word_chars - 12 * n_words", high=0),
)
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


def _covered(places: Column) -> Column:
    """Words that three-word windows at these ascending places cover."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns SIGNALS, all long.

    Repeats: each three-word window is hashed; texts whose hashes are all distinct are done. With up to FEW repeated hashes their
    places are looked up one by one, else windows are sorted with their places. Both give the same number.
    """
    docs = docs.drop(*SIGNALS)
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(WHITE_CHARS))
    out = docs.withColumn("_w", F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE)))
    w, n = F.col("_w"), F.size("_w")
    grams = F.transform(F.arrays_zip(F.slice(w, 1, n - 2), F.slice(w, 2, n - 2), F.slice(w, 3, n - 2)), lambda x: F.xxhash64(x))
    out = out.withColumn("_h", F.when(n >= 4, grams))
    h = F.col("_h")
    out = out.withColumn("_s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)))
    s = F.col("_s")
    out = out.withColumn("_d", F.when(s.isNotNull(), F.array_distinct(F.filter(s, lambda x, k: x.eqNullSafe(F.get(s, k + 1))))))
    few = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains("_d", x), i)), lambda i: i.isNotNull())
    g = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn("_g", F.when(F.size("_d") > FEW, g))
    g = F.col("_g")
    same = lambda x, k: F.coalesce(F.get(g, k)["h"] == x["h"], F.lit(False))
    many = F.sort_array(F.transform(F.filter(g, lambda x, k: same(x, k + 1) | (F.when(k > 0, same(x, k - 1)).otherwise(False))), lambda x: x["i"]))
    out = out.withColumn("_p", F.when(g.isNotNull(), many).when(F.col("_d").isNotNull(), few))
    out = out.withColumn("_l", F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE_CHARS))) > 0))
    return out.select(
        *docs.columns,
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("_p")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: x.isin(STOP_FORMS))).cast("long").alias("n_stop_words"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column: every rule holds."""
    out = F.lit(True)
    for r in rules:
        v = F.expr(r.value)
        for test in (None if r.low is None else v >= r.low, None if r.high is None else v <= r.high):
            out = out if test is None else out & test
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents with their signals, base_failed and kept. A filter on kept that Catalyst pushed below the signals would repeat their expressions for each rule; a row number that kept refers to holds it above."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = signals(docs.drop("base_failed", "kept"), text).withColumn("_above", F.monotonically_increasing_id())
    return found.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compile_rules(rules) & (F.col("_above") >= 0)).drop("_above")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents that are kept, with their own columns."""
    return judge(docs, rules, text).where("kept").select(*docs.columns)
