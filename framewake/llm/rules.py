"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Every measure is a Spark expression over the text alone: no user function, no shuffle, no second scan. A measure used
by several others is bound once as a lambda variable (`_let`), as a projection that names it would be inlined and
computed again wherever it is used.

Null texts have no words. Empty texts, or such without words, fail the base rule. Repeated rows get equal results.
An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
#: Fixed values of the word rule.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Common words of the languages met (fixed values).
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou mais comme on aux elle son ses leur cette nous vous ils été être sa".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue".split(),
}


@dataclass(frozen=True)
class Rule:
    """measure must be at least low and at most high; a text with fewer than min_words words is not held to it."""

    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The method's threshold table; ratios are in parts of the whole.
THRESHOLDS = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", high=0.06),
    Rule("bang_ratio", high=0.25),
    Rule("upper_ratio", high=0.50),
    Rule("stop_ratio", low=0.02, min_words=50),
    Rule("dup_line_ratio", high=0.50),
    Rule("bar_line_ratio", high=0.34),
)


def _let(value: Column, body) -> Column:
    """body(x) with x bound to value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(words: Column, window: int) -> Column:
    """How many words stand in windows (of so many words) that occur twice or more."""
    n = F.size(words)

    def spans(at: Column) -> Column:
        """Words under the windows that begin at the sorted places."""
        first = F.struct(F.lit(-window).alias("end"), F.lit(0).alias("sum"))
        step = lambda acc, p: F.struct(p.alias("end"), (acc["sum"] + F.least(F.lit(window), p - acc["end"])).alias("sum"))
        return F.aggregate(at, first, step, lambda acc: acc["sum"])

    def repeated(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # a place counts if its hash equals the one before or after it in the sorted order
        near = _let(
            F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), pairs, F.array(F.lit(None).cast("struct<h:bigint,i:int>"))),
            lambda s: F.filter(F.zip_with(F.slice(s, 2, F.size(s) - 2), F.arrays_zip(F.slice(s, 1, F.size(s) - 2).alias("a"), F.slice(s, 3, F.size(s) - 2).alias("b")), lambda x, y: F.when((x["h"] == y["a"]["h"]) | (x["h"] == y["b"]["h"]), x["i"])), lambda p: p.isNotNull()),
        )
        return spans(F.sort_array(near))

    def windows(hashed: Column) -> Column:
        """A hash of each window, from hashes of its halves: window is a power of two."""


        def pairs(k: int):
            return lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - k), F.slice(h, F.lit(1 + k), F.size(h) - k), lambda a, b: F.xxhash64(a, b))

        step = 1
        while step < window:
            hashed = _let(hashed, pairs(step))
            step *= 2
        return hashed

    inside = _let(windows(F.transform(words, lambda w: F.xxhash64(w))), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h)))
    return F.when(n <= window, F.lit(0)).otherwise(inside)


def _chars(text: Column, kind: str) -> Column:
    """Code points of a kind: the text's length without the others."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", ""))


def _measures(text: Column) -> Column:
    """All counts of a text as one struct."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    stops = sorted(set().union(*STOP_WORDS.values()))

    def of_words(w: Column) -> list[Column]:
        return [
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _covered(w, WINDOW).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(stops))).cast("long").alias("n_stops"),
        ]

    def of_lines(x: Column) -> list[Column]:
        bars = F.size(F.filter(x, lambda line: F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 3))
        return [F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), bars.cast("long").alias("n_bar_lines")]

    by_word = _let(words, lambda w: F.struct(*of_words(w)))
    by_line = _let(lines, lambda x: F.struct(*of_lines(x)))
    return F.struct(
        by_word.alias("w"), by_line.alias("l"), _chars(text, SYMBOLS).cast("long").alias("n_symbols"), (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"), _chars(text, "\\p{Lu}").cast("long").alias("n_upper"),
    )


#: Measure -> its expression over the counts of a text.
_RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "word_chars"),
    "bang_ratio": ("n_bangs", "n_words"),
    "upper_ratio": ("n_upper", "word_chars"),
    "stop_ratio": ("n_stops", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "bar_line_ratio": ("n_bar_lines", "n_lines"),
}


def compile_rules(rules: tuple[Rule, ...], count) -> Column:
    """The table as one boolean: no rule is broken. count(name) gives the column of a count; a ratio to nothing breaks none."""
    ok = F.lit(True)
    for rule in rules:
        part, whole = _RATIOS[rule.measure]
        broken = F.lit(False)
        # products of whole numbers and a constant: the same in any engine
        if rule.low is not None:
            broken = broken | (count(part).cast("double") < F.lit(rule.low) * count(whole).cast("double"))
        if rule.high is not None:
            broken = broken | (count(part).cast("double") > F.lit(rule.high) * count(whole).cast("double"))
        ok = ok & ~(broken & (count(whole) > 0) & (count("n_words") >= rule.min_words))
    return ok


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Counts and verdict of every document: the base rule, then the threshold table, in one projection.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows. kept: not base_failed and no
    rule broken.
    """
    measured = docs.select(F.col(id_col), _measures(F.col(text)).alias("m"))
    count = _counts("m")
    base = (count("n_words") < 20) | (100 * count("n_repeat_words") > 30 * count("n_words"))
    plain = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    extra = ("n_lines", "n_stops", "n_upper", "n_bangs", "n_bar_lines")
    return measured.select(id_col, *[count(c).alias(c) for c in plain], base.alias("base_failed"), (~base & compile_rules(rules, count)).alias("kept"), *[count(c).alias(c) for c in extra])


def _counts(struct: str):
    where = {"n_words": "w", "word_chars": "w", "n_repeat_words": "w", "n_stops": "w", "n_lines": "l", "n_dup_lines": "l", "n_bar_lines": "l"}
    return lambda name: F.col(f"`{struct}`.{where[name]}.{name}" if name in where else f"`{struct}`.{name}")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """The rows of docs, all their columns as they were, that pass the base rule and the table."""
    from .common import fresh

    name = fresh(docs, "measures")[0]
    count = _counts(name)
    base = (count("n_words") < 20) | (100 * count("n_repeat_words") > 30 * count("n_words"))
    return docs.withColumn(name, _measures(F.col("text"))).where(~base & compile_rules(rules, count)).select(*[F.col(f"`{c}`") for c in docs.columns])
