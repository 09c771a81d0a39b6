"""Quality rules whose thresholds are controlled for risk on labelled holdouts.

Every rule measures a document and rejects it above a cutoff. For each stratum and rule the
cutoffs of a fixed grid are tested on the labelled good documents: a cutoff is certified when
the exact binomial tail P(Bin(n, risk) <= k), with k false rejections among n, is at most
``delta`` divided by the number of tests made (Bonferroni over strata, rules and cutoffs). The
strictest certified cutoff is taken. So, with probability ``1 - delta``, no rule in any stratum
rejects more than ``risk / rules`` of the good documents, and all rules together no more than
``risk``. A rule without a certified cutoff rejects nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cutoffs to test, strict to lenient.
GRID: Mapping[str, Sequence[float]] = {
    "symbol_share": (0.05, 0.1, 0.2, 0.4),
    "dup_line_share": (0.1, 0.2, 0.3, 0.5),
    "repeat_share": (0.1, 0.2, 0.3, 0.4),
    "mean_word_chars": (10.0, 12.0, 15.0, 20.0),
}
RISK, DELTA = 0.05, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
_SYMBOL = r"[#*$%&|<>]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluating ``value`` once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _repeated(windows: Column) -> Column:
    """Words in windows of three that occur twice or more, given the hash of each window."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(
        s,
        lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))
        | ((i < F.size(s) - 1) & (F.get(s, i + 1)["h"] == x["h"])),
    )
    starts = F.sort_array(F.transform(bind(pairs, twice), lambda x: x["i"]))
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("words"))
    step = lambda a, x: F.struct(
        x.alias("last"), (a["words"] + F.least(F.lit(3), x - a["last"])).alias("words")
    )
    return F.aggregate(starts, zero, step, lambda a: a["words"])


def _repeat_words(words: Column) -> Column:
    window = lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    windows = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), window)
    return bind(
        windows,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_repeated(h)),
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with its counts and the measures of the rules.

    A NULL text counts as empty. Windows of three words are compared by 64-bit hashes.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(_WORD))
    facts = bind(
        words,
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            F.char_length(F.array_join(w, "")).alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    line_facts = bind(
        lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct"))
    )
    counted = docs.select(
        *[c for c in docs.columns if c != text],
        facts.alias("_facts"),
        line_facts.alias("_lines"),
        F.regexp_count(body, F.lit(_SYMBOL)).cast("long").alias("_symbols"),
    )
    names = ["n_words", "word_chars", "n_repeat_words"]
    kept = [c for c in counted.columns if not c.startswith("_") and c not in (*names, *GRID)]
    counts = counted.select(
        *kept,
        *[F.col(f"_facts.{n}").cast("long").alias(n) for n in names],
        F.col("_symbols").alias("n_symbols"),
        F.col("_lines.n").cast("long").alias("n_lines"),
        (F.col("_lines.n") - F.col("_lines.distinct")).cast("long").alias("n_dup_lines"),
    )
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    short = F.col("n_words") < MIN_WORDS
    repetitive = F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    return counts.select(
        "*",
        share("n_symbols", "n_words").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("word_chars", "n_words").alias("mean_word_chars"),
        (short | repetitive).alias("base_failed"),
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly, by the recurrence of its terms in logarithms."""
    odds = F.log(F.lit(p / (1 - p)))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (a["sum"] + F.exp(term)).alias("sum"))

    none = (n * F.log(F.lit(1 - p))).cast("double")
    start = F.struct(none.alias("term"), F.exp(none).alias("sum"))
    counts = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(counts, start, step, lambda a: a["sum"])


def certified_cutoffs(
    good: DataFrame,
    stratum: str,
    grid: Mapping[str, Sequence[float]] = GRID,
    risk: float = RISK,
    delta: float = DELTA,
) -> DataFrame:
    """``stratum``, ``rule``, ``cutoff``, ``k`` and ``n``: the strictest certified cutoff, or NULL.

    ``good`` has the stratum and one column per rule of documents known to be good. A NULL
    stratum is one of its own; NULL measures count in n and are never rejected. There is
    one row per stratum and rule.
    """
    tests = [(rule, j, cut) for rule, cuts in grid.items() for j, cut in enumerate(cuts)]
    counted = good.groupBy(stratum).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(rule) > cut).alias(f"_{rule}_{j}") for rule, j, cut in tests],
    )
    made = len(tests) * max(1, counted.count())
    level = risk / len(grid)
    # Above its expectation a count is never certified.
    at_most = lambda k: F.when(k <= F.col("n") * level, binomial_tail(k, F.col("n"), level)).otherwise(1.0)
    test = F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cut"), F.col(f"_{r}_{j}").alias("k"))
        for r, j, c in tests
    ]))
    tested = (
        counted.select(stratum, "n", test.alias("_t"))
        .select(stratum, "n", "_t.*", (at_most(F.col("_t.k")) <= delta / made).alias("_ok"))
    )
    return tested.groupBy(stratum, "rule").agg(
        F.min(F.when(F.col("_ok"), F.col("cut"))).alias("cutoff"),
        F.min_by("k", F.when(F.col("_ok"), F.col("cut"))).alias("k"),
        F.first("n").alias("n"),
    )


def apply_cutoffs(measured: DataFrame, cutoffs: DataFrame, stratum: str, grid: Mapping = GRID) -> DataFrame:
    """``measured`` with ``failed_rules`` and ``kept``.

    One row of cutoffs per stratum is joined. Strata without labels have no cutoffs and keep
    what passes the base rules.
    """
    wide = cutoffs.groupBy(F.col(stratum).alias("_stratum")).agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in grid]
    )
    joined = measured.join(wide, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    failed = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"_cut_{r}"), F.lit(r)) for r in grid]))
    return joined.select(
        *measured.columns,
        failed.alias("failed_rules"),
        (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"),
    )


def risk_controlled(measured: DataFrame, labels: DataFrame, stratum: str, **options) -> DataFrame:
    """``measured`` with verdicts; cutoffs from those rows whose label says good.

    ``labels`` has ``doc_id`` and ``quality``; a document with several labels is good if all
    of them are. Documents that fail the base rules take no part in the tests.
    """
    votes = labels.groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    good = measured.filter(~F.col("base_failed")).join(votes.filter(F.col("_quality") == 1), "doc_id", "left_semi")
    return apply_cutoffs(measured, certified_cutoffs(good, stratum, **options), stratum)
