"""Quality rules as a short-circuit cascade, in native expressions only.

Every rule's cost and selectivity are estimated on a sample; rules then run in falling order of
rejections per cost, and a row that one rule rejects is not shown to the next (``CASE WHEN``
evaluates its branches in order and stops at the first hit). The order changes only how much is
computed, never which rows stay. The sample is of a few input files where the table is read from many. One job over it
takes the time before and after each feature of each text; a rule costs the median times of the features that it has to compute, in
powers of two, so that reruns agree. Features that are columns already cost nothing, and no rule costs less than FLOOR.

The counts of the contract are needed for every row, so the verdict query computes them first and the
cascade's lazy features (letters, bullets, ellipses) only for rows that nothing before them has rejected.

Defined cases: a null or empty text has no words and fails ``few_words``; repeated rows are judged
alike; an empty table gives an empty result; columns of the input are kept untouched, whatever
their names, because verdicts are computed from the text column alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadforge.llm.common import SPACE, let, n_words, stored, words

SYMBOLS = r"[#*$%&|<>]"
#: Words with a letter (from it to the word's end), lines that begin with a bullet, lines that end in an ellipsis.
LETTERS, BULLETS, ELLIPSES = r"\p{L}[^\x20\x09-\x0D]*", r"(^|\n)[\x20\x09]*[-*•]", r"(\.\.\.|…)[\x20\x09\x0D]*(\n|\z)"
#: Input files that a sample is taken from, at most.
SAMPLE_FILES = 8
#: What any rule costs at least, in nanoseconds for a row: below it are comparisons of columns, which all cost the same.
FLOOR = 1024
#: A packed long holds 33 bits of a window's hash over 31 bits of its position.
POSITION_BITS = 31


def repeated_window_words(text: Column, width: int = 3) -> Column:
    """Words of a text that lie in ``width``-word windows found twice or more, the first included.

    32 hash bits and the position of every window are packed in one long and sorted; neighbours
    with equal hash bits are candidates, and candidates count only if their words are equal too.
    Every array is bound to a lambda variable: however the optimizer moves the expression, it is
    computed once for each text.
    """
    mask = (1 << POSITION_BITS) - 1

    def packed(h: Column) -> Column:
        place = lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, width)))
        return F.sort_array(F.transform(F.slice(h, 1, F.size(h) - (width - 1)), lambda x, i: F.shiftleft(F.shiftrightunsigned(place(x, i), 32), POSITION_BITS).bitwiseOR(i.cast("long"))))

    def candidates(s: Column) -> Column:
        pairs = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a.bitwiseXOR(b) <= mask, F.array(a.bitwiseAND(mask).cast("int"), b.bitwiseAND(mask).cast("int"))))
        return F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))

    def confirmed(w: Column, places: Column) -> Column:
        named = F.transform(places, lambda i: F.struct(F.concat_ws(" ", *(F.get(w, i + k) for k in range(width))).alias("s"), i.alias("i")))
        repeated = let(F.sort_array(named), lambda x: F.filter(x, lambda v, i: (F.get(x, i + 1)["s"] == v["s"]) | (F.get(x, i - 1)["s"] == v["s"])))
        return F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(*(x["i"] + k for k in range(width)))))))

    def count(w: Column) -> Column:
        found = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(packed(h), candidates))
        return F.when(F.size(w) < width, 0).otherwise(let(found, lambda c: F.when(F.size(c) == 0, 0).otherwise(confirmed(w, c))))

    return let(words(text), count).cast("long")


def features(text: Column) -> dict[str, Column]:
    """Counts over a whole text, as lazy columns."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": n_words(text),
        "word_chars": F.char_length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_window_words(text),
        **lazy_features(text),
    }


def lazy_features(text: Column) -> dict[str, Column]:
    """Features that only the cascade needs."""
    t = F.coalesce(text, F.lit(""))
    return {name: F.regexp_count(t, F.lit(pattern)).cast("long") for name, pattern in (("n_letter_words", LETTERS), ("n_bullets", BULLETS), ("n_ellipses", ELLIPSES))}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[dict[str, Column]], Column]


#: Production rules. The first two are the base rules of the contract.
RULES = (
    Rule("few_words", lambda f: f["n_words"] < 50),
    Rule("repeated_words", lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
    Rule("word_length", lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 15 * f["n_words"])),
    Rule("symbols", lambda f: 2 * f["n_symbols"] > f["n_words"]),
    Rule("duplicate_lines", lambda f: 2 * f["n_dup_lines"] > f["n_lines"]),
    Rule("few_letters", lambda f: 2 * f["n_letter_words"] < f["n_words"]),
    Rule("bullet_lines", lambda f: 10 * f["n_bullets"] > 9 * f["n_lines"]),
    Rule("ellipsis_lines", lambda f: 2 * f["n_ellipses"] > f["n_lines"]),
)
BASE_RULES = RULES[:2]
VERDICT = "__leadforge_verdict"


def sample_of(df: DataFrame, text: str, rows: int) -> DataFrame:
    """About ``rows`` texts (column t), stored in four files; of SAMPLE_FILES input files if the table is read from more."""
    files = sorted(df.inputFiles())
    some = df
    if len(files) > SAMPLE_FILES:
        picked = [f.rpartition("/")[2] for f in files[:: -(-len(files) // SAMPLE_FILES)]]
        try:
            part = df.where(F.col("_metadata.file_name").isin(picked))
            some = df if part.select(F.lit(1)).isEmpty() else part
        except AnalysisException:  # not a plain table: it has no file paths
            pass
    some = some.select(some[text].alias("t"))
    total = some.count()
    return stored(some.sample(fraction=min(1.0, rows / total) if total else 1.0, seed=7).repartition(4), "sample")


def needed(rule: Rule) -> list[str]:
    """Names of the features that a rule reads."""
    read: list[str] = []

    class Asked(dict):
        def __missing__(self, name: str) -> Column:
            read.append(name)
            return F.lit(0)

    rule.rejects(Asked())
    return sorted(set(read))


def _clocked(value: Column) -> Column:
    """struct(a, v, b): a value between the times before and after it. A struct's fields are evaluated in order, and one with a clock in it at once."""
    now = lambda: F.expr("java_method('java.lang.System', 'nanoTime')").cast("long")
    return F.struct(now().alias("a"), value.alias("v"), now().alias("b"))


def measured(sample: DataFrame, rules: tuple[Rule, ...], known: tuple[str, ...] = ()) -> list[tuple[float, int]]:
    """Share of rows rejected and nanoseconds for a row of each rule, from one job over ``sample`` (column t)."""
    f = features(F.col("t"))
    timed = sorted({n for r in rules for n in needed(r)} - set(known))
    rows = sample.select("t", *(f[n].alias(n) for n in known)).select(*known, *(_clocked(f[n]).alias(n) for n in timed), _clocked(F.lit(0)).alias("_idle"))
    value = {n: F.col(n) for n in known} | {n: F.col(n)["v"] for n in timed}
    span = lambda n: F.percentile_approx(F.col(n)["b"] - F.col(n)["a"], 0.5)
    hits = [F.avg(F.coalesce(r.rejects(value), F.lit(False)).cast("int")) for r in rules]
    got = list(rows.agg(*hits, *map(span, [*timed, "_idle"])).first())
    shares, spans = [x or 0.0 for x in got[: len(rules)]], dict(zip([*timed, "_idle"], (x or 0 for x in got[len(rules) :])))
    costs = [sum(max(spans[n] - spans["_idle"], 0) for n in needed(r) if n in spans) for r in rules]
    return [(share, 2 ** round(math.log2(max(cost, FLOOR)))) for share, cost in zip(shares, costs)]


def cascade_order(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, known: tuple[str, ...] = ()) -> list[Rule]:
    """Rules by rejections per cost, as measured on about ``sample_rows`` rows; equals keep their order. ``known``: features that the cascade finds as columns."""
    rated = measured(sample_of(df, text, sample_rows), rules, known)
    return [rule for _, rule in sorted(zip(rated, rules), key=lambda x: -x[0][0] / x[0][1])]


def first_rejection(df: DataFrame, text: Column, ordered: list[Rule], known: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with column VERDICT: the first rule that rejects a row, null if none does.

    Rules after the first hit are not evaluated. ``known``: features that are columns already.
    """
    f, verdict = known or features(text), F
    for rule in ordered:
        verdict = verdict.when(rule.rejects(f), F.lit(rule.name))
    return df.withColumn(VERDICT, verdict if ordered else F.lit(None).cast("string"))


def quality_filter(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """Rows of ``df`` that no rule rejects, with all their columns."""
    ordered = cascade_order(df, text, rules, sample_rows)
    return first_rejection(df, df[text], ordered).where(F.col(VERDICT).isNull()).drop(VERDICT)


#: Columns of :func:`quality_verdicts` between key and verdicts.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def quality_verdicts(df: DataFrame, text: str = "text", key: str = "doc_id", sample_rows: int = 2000) -> DataFrame:
    """Counts and verdict of each row: key, the counts, ``base_failed``, ``kept``."""
    ordered = cascade_order(df, text, tuple(r for r in RULES if r not in BASE_RULES), sample_rows, COUNTS)
    f = features(F.col("t"))
    counted = df.select(df[key].alias(key), df[text].alias("t")).select(F.col(key), "t", *(f[n].alias(n) for n in COUNTS))
    known = {n: F.col(n) for n in COUNTS} | lazy_features(F.col("t"))
    judged = first_rejection(counted, F.col("t"), [*BASE_RULES, *ordered], known=known)
    base = F.coalesce(F.col(VERDICT).isin([r.name for r in BASE_RULES]), F.lit(False))
    return judged.select(key, *COUNTS, base.alias("base_failed"), F.col(VERDICT).isNull().alias("kept"))
