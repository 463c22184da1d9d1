"""Operator 9: quality rules as a short-circuit cascade, with DataFrame functions only.

Each rule's cost and the share of rows that it rejects are measured on a bounded sample; the cascade
tests the rules in the order of rejection per cost, and a row that fails a rule is not tested further.
The order changes the time, never a verdict. Where rows are only filtered, what a rule alone needs is computed when its
turn comes, so rows that are rejected early cost little.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh

#: Rows on which rules are measured, at most (those with the smallest hashed ids).
SAMPLE_ROWS = 400
#: A rule is timed on each sampled row so often, and that so many times; the shortest time counts.
REPEATS, TRIALS = 8, 3
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# A fixed value of the contract: words are runs of other characters than these blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: A fixed value of the contract: texts of fewer words fail the base.
MIN_WORDS = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once even if the body uses it often or inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def repeated_words(hashes: Column) -> Column:
    """How many words lie in a window of three that occurs twice or more.

    Most texts have none: then all windows' hashes differ. Otherwise the hashed windows are sorted with their positions;
    equal neighbours give the positions of repeated windows; a sorted position covers three words, or as many as lie
    before the next one.
    """
    def of_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - 3)
        return let(F.transform(starts, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))), of_windows)

    def of_windows(windows: Column) -> Column:
        numbered = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(F.sort_array(numbered), repeats))

    def repeats(s: Column) -> Column:
        m = F.size(s)
        found = F.zip_with(
            F.slice(s, 1, F.greatest(m - 1, F.lit(0))), F.slice(s, 2, F.greatest(m - 1, F.lit(0))),
            lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
        )
        return let(F.sort_array(F.array_distinct(F.flatten(found))), covered)

    def covered(p: Column) -> Column:
        k = F.size(p)
        gaps = F.zip_with(F.slice(p, 1, F.greatest(k - 1, F.lit(0))), F.slice(p, 2, F.greatest(k - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(3)))
        return F.when(k == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda t, g: t + g))

    return F.when(F.size(hashes) < 4, F.lit(0)).otherwise(let(hashes, of_hashes)).cast("long")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def symbols_of(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (longs) of the whole text; a null
    text has none of anything. Columns of df with these names are replaced."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    of_words = fresh(df, "of_words")
    counted = let(word_hashes(text), lambda h: F.struct(F.size(h).cast("long").alias("n"), repeated_words(h).alias("repeated")))
    others = [F.col(f"`{c}`") for c in df.columns if c not in FEATURES]
    return df.withColumn(of_words, counted).select(
        *others, F.col(of_words).n.alias("n_words"), F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        symbols_of(text).alias("n_symbols"), duplicate_lines(text).alias("n_dup_lines"), F.col(of_words).repeated.alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A condition that rows must fulfil, over a text and its features."""

    name: str
    passes: Callable[[Column, dict[str, Column]], Column]


def rules() -> list[Rule]:
    """The rules beyond the base. They are wide: ordinary prose of any language passes all of them."""
    lines = lambda t: F.size(F.split(t, "\n", -1))
    matches = lambda t, pattern: F.size(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    return [
        Rule("words of usual length", lambda t, f: f["word_chars"].between(2 * f["n_words"], 15 * f["n_words"])),
        Rule("few symbols", lambda t, f: 10 * f["n_symbols"] <= f["n_words"]),
        Rule("few repeated lines", lambda t, f: 2 * f["n_dup_lines"] <= lines(t)),
        Rule("mostly letters", lambda t, f: 10 * F.length(F.regexp_replace(t, r"[^\p{L}\p{M}]+", "")) >= 6 * f["word_chars"]),
        Rule("few lines end cut off", lambda t, f: 10 * matches(t, r"(?:\.\.\.|…)[ \t]*(?:\n|$)") <= 5 * lines(t)),
        Rule("few bullet lines", lambda t, f: 10 * matches(t, r"(?:^|\n)[ \t]*[•‣*-]") <= 9 * lines(t)),
    ]


#: The second half of the base, which a filter tests as one rule among the others.
REPEATED = Rule("few repeated windows", lambda t, f: 100 * f["n_repeat_words"] <= 50 * f["n_words"])


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / self.seconds


def given_features() -> dict[str, Column]:
    """All features, as columns."""
    return {name: F.col(name) for name in FEATURES}


def features_in_turn(text: Column, cheap: Callable[[str], Column]) -> dict[str, Column]:
    """Three features that are cheap and given; the others are computed from the text where they are used."""
    return {name: cheap(name) for name in FEATURES[:3]} | {"n_dup_lines": duplicate_lines(text), "n_repeat_words": repeated_words(word_hashes(text))}


def estimates(df: DataFrame, chosen: list[Rule], id_col: str = "doc_id", text_col: str = "text", in_turn: bool = False) -> list[Estimate]:
    """Each rule's seconds and rejected share on the sample, best worth first.

    The sample's ids are picked by hash from the id column alone; its rows with features stay in Spark's
    storage. A job evaluates one rule REPEATS times on each row; what the same job takes that only reads the text
    is subtracted, and of TRIALS times the shortest counts. Times below a twentieth of that are all the same: they can't
    be told apart. With `in_turn` the features that a rule computes itself belong to its cost.
    """
    ids = [r[0] for r in df.where(F.col(id_col).isNotNull()).select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_ROWS).collect()]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sample = with_features(df.where(F.col(id_col).isin(ids)).select(text.alias("text")).limit(2 * SAMPLE_ROWS)).repartition(1).cache()
    features = features_in_turn(F.col("text"), F.col) if in_turn else given_features()

    def timed(condition: Column) -> tuple[float, int]:
        took, found = [], 0
        for _ in range(TRIALS):
            began = time.perf_counter()
            found = sample.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(REPEATS)))).agg(F.count_if(condition)).first()[0]
            took.append(time.perf_counter() - began)
        return min(took), found // REPEATS

    try:
        rows = max(sample.count(), 1)
        reading, _ = timed(F.length("text") < 0)
        out = []
        for rule in chosen:
            seconds, rejected = timed(~rule.passes(F.col("text"), features))
            out.append(Estimate(rule, max(seconds - reading, 0.05 * reading), rejected / rows))
    finally:
        sample.unpersist()
    return sorted(out, key=lambda e: (-e.worth, e.seconds))


def cascade(ordered: list[Rule], text: Column, features: dict[str, Column]) -> Column:
    """Whether a row passes all rules; later rules aren't evaluated for rows that an earlier one rejects."""
    verdict = F.lit(True)
    for rule in reversed(ordered):
        verdict = F.when(~F.coalesce(rule.passes(text, features), F.lit(False)), F.lit(False)).otherwise(verdict)
    return verdict


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the features, base_failed and kept.

    A null, empty or blank text has no words: the base fails and it isn't kept. Every row is judged on its own whole text, so
    repeated rows get equal verdicts; an empty table gives none. Other columns stay; those with the names of added ones
    are replaced. No shuffle of texts.
    """
    ordered = [e.rule for e in estimates(df, rules(), id_col, text_col)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = with_features(df, text_col).withColumn("base_failed", base_failed())
    return rows.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(ordered, text, given_features())))


def kept_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that pass base and cascade, with df's columns: those that `judged` keeps.

    The count of words comes first; the base's other half is a rule of the cascade, by its own cost and rejection."""
    ordered = [e.rule for e in estimates(df, [REPEATED, *rules()], id_col, text_col, in_turn=True)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cheap = F.struct(text.alias("text"), F.size(words_of(text)).cast("long").alias("n_words"), F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"), symbols_of(text).alias("n_symbols"))

    def passes(f: Column) -> Column:
        return F.when(f["n_words"] < MIN_WORDS, F.lit(False)).otherwise(cascade(ordered, f["text"], features_in_turn(f["text"], lambda name: f[name])))

    return df.where(let(cheap, passes))
