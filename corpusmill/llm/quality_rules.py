"""Quality rules: per-document counts, and verdicts per host.

Native: DataFrame functions only. A document's counts come from its own text.
Each rule's failures are then added up per host (partial sums, so a host with a
third of all rows sends one row per task), the rate is shrunk towards the
corpus with a beta prior fitted by moments to the hosts' rates. A document goes if it fails a
base rule, if its host's rate is above ``reject_rate``, or if that rate is above
``suspect_rate`` and the document fails a soft rule itself.

Defined cases: null or blank text has no words and fails the base rules; a
null host is a host of its own; extra columns, whatever their names, are ignored
by ``report`` and kept by ``keep``; repeated rows are judged one by one; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import let, small, words
from corpusmill.session import cut_lineage

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    #: fails if 100 * repeated words > this * words
    repeat_percent: int = 30
    #: fails if 100 * symbols > this * characters in words (soft)
    symbol_percent: int = 25
    #: fails if 100 * duplicate lines > this * words (soft)
    line_percent: int = 10
    #: above this shrunk rate for any rule, a host's soft failures count
    suspect_rate: float = 0.5
    #: above this one, all of the host's documents go
    reject_rate: float = 0.9
    #: documents that the prior counts for where hosts' rates don't differ
    prior_weight: float = 20.0


HOST_RULES = ("short", "repeat", "symbol", "line")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeat_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur more than once.

    Windows are compared by 64-bit hashes of their words' hashes. Positions are
    found by one sort of (hash, position), never by searching a list per window,
    so a very long text costs n log n.
    """

    def covered(win: Column) -> Column:
        pairs = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(
            pairs,
            lambda s: F.filter(
                s, lambda v, k: F.coalesce(F.get(s, k - 1)["x"] == v["x"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["x"] == v["x"], F.lit(False))
            ),
        )
        starts = F.sort_array(F.transform(twice, lambda v: v["i"]))
        gaps = let(starts, lambda p: F.transform(p, lambda v, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - v, F.lit(window)))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    counted = let(
        F.transform(tokens, lambda w: F.xxhash64(w)),
        lambda h: let(windows(h), lambda win: F.when(F.size(F.array_distinct(win)) < F.size(win), covered(win)).otherwise(F.lit(0).cast("long"))),
    )
    return F.when(F.size(tokens) > window, counted).otherwise(F.lit(0).cast("long"))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.length(_without(x, SPACES)) > 0)
    out = {
        "word_chars": F.length(_without(whole, SPACES)).cast("long"),
        "n_symbols": (F.length(whole) - F.length(_without(whole, SYMBOLS))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        # size and windows share one split of the text
        "_w": let(words(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"))),
    }
    found = docs.withColumns(out)
    return found.withColumns({"n_words": F.col("_w.n"), "n_repeat_words": F.col("_w.r")}).drop("_w")


def _fails(rules: Rules) -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "fails_short": n < rules.min_words,
        "fails_repeat": 100 * F.col("n_repeat_words") > rules.repeat_percent * n,
        "fails_symbol": 100 * F.col("n_symbols") > rules.symbol_percent * F.col("word_chars"),
        "fails_line": 100 * F.col("n_dup_lines") > rules.line_percent * n,
    }


def host_verdicts(features: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per ``host``: n_docs, the shrunk failure rate of each rule,
    ``suspect`` and ``rejected``, from features with the fails_* columns.

    The prior of a rule is the beta distribution with the mean and the variance
    of the hosts' rates, each host being one sample. Only one row per host is
    left at this point, and one row of moments.
    """
    sums = features.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(f"fails_{r}").cast("long")).alias(f"k_{r}") for r in HOST_RULES])
    rates = cut_lineage(sums.select("*", *[(F.col(f"k_{r}") / F.col("n_docs")).alias(f"r_{r}") for r in HOST_RULES]))
    both = [f(F.col(f"r_{r}")).alias(f"{k}_{r}") for r in HOST_RULES for k, f in (("m", F.avg), ("v", F.var_pop))]
    moments = rates.agg(*both).first().asDict()  # eight numbers

    def shrunk(r: str) -> Column:
        m, v = moments[f"m_{r}"] or 0.0, moments[f"v_{r}"] or 0.0
        weight = m * (1 - m) / v - 1 if v > 0 and m * (1 - m) > v else rules.prior_weight
        return ((F.col(f"k_{r}") + weight * m) / (F.col("n_docs") + weight)).alias(f"rate_{r}")

    scored = rates.select("host", "n_docs", *[shrunk(r) for r in HOST_RULES])
    worst = F.greatest(*[F.col(f"rate_{r}") for r in HOST_RULES])
    return scored.withColumns({"suspect": worst > rules.suspect_rate, "rejected": worst > rules.reject_rate})


def _joined(features: DataFrame, rules: Rules) -> DataFrame:
    """Features with base_failed and kept, by the verdicts of their hosts."""
    soft, base = F.col("fails_symbol") | F.col("fails_line"), F.col("fails_short") | F.col("fails_repeat")
    bad = cut_lineage(host_verdicts(features, rules).where("suspect").select(F.col("host").alias("bad_host"), "rejected"))
    found = features.join(small(bad), F.col("host").eqNullSafe(F.col("bad_host")), "left")
    stays = F.when(F.col("rejected").isNull(), True).otherwise(~F.col("rejected") & ~soft)
    return found.withColumns({"base_failed": base, "kept": ~base & stays})


def report(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", rules: Rules = Rules()) -> DataFrame:
    """Per row: key, the counts, base_failed, kept. Texts are read once; the
    counts are checkpointed, as the sums and the join both read them."""
    slim = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text"))
    features = cut_lineage(counts(slim).drop("text")).withColumns(_fails(rules))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return _joined(features, rules).select(F.col("key").alias(key), *names)


def keep(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged. Rows need no key:
    the counts are computed for the sums and again beside the texts, so that
    texts stay where they are instead of being joined to verdicts."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(host).alias("host"), F.col(text).alias("text"))
    features = counts(whole).withColumns(_fails(rules))
    return _joined(features, rules).where("kept").select("row.*")
