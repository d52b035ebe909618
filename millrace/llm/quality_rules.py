"""Operator 5: learned decision lists over statistics of a text.

fit() grows rules that predict a bad document by sequential covering: each rule is a conjunction of threshold tests on the statistics below,
grown test by test for the best FOIL gain over a grow part of the labelled rows, then pruned from its end against the other part. Rules are
ordered; the list becomes one conditional expression. Counting is done by Spark: each step groups the labelled rows by (statistic, bin, label).

Nulls: a null text has no words; a null label is no label. Empty and wordless texts fail the base test. Very long texts are counted whole. Columns of the table named like a statistic are replaced by judge(); kept() keeps
them. Ties between tests go to the first statistic; of thresholds that part the rows alike
the middle one is taken. Repeated rows count as often as they stand. Empty tables give an empty list, which rejects nothing beyond the base test.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import let, native_words, nested, remove_stored, stored

SYMBOLS = "#*$%&|<>"
#: Labelled rows to learn from at most; the rows with the least hashes of doc_id are taken.
SAMPLE = 20_000
CUTS = 32

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Whole numbers, per mille of words, of letters or of lines.
FEATURES = ["n_words", "chars_per_100_words", "symbols_per_mille", "dup_lines_per_mille", "repeats_per_mille", "bangs_per_mille", "capitals_per_mille", "digits_per_mille", "met_before_per_mille", "words_per_line"]


def repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more among the words."""

    def of(w: Column) -> Column:
        gram = lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))
        return let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), gram)), covered)

    def covered(s: Column) -> Column:
        same = lambda x, j: F.coalesce(x["g"] == F.get(s, j - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(s, j + 1)["g"], F.lit(False))
        spans = F.transform(F.filter(s, same), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
        return F.size(F.array_distinct(F.flatten(spans)))

    return let(words, lambda w: F.when(F.size(w) >= 4, of(w)).otherwise(0))


def statistics(docs: DataFrame, extra: bool = True) -> DataFrame:
    """docs with the columns of BASE (long), and with those of FEATURES if extra."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ink = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lines = let(ink, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    per_word = let(native_words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("repeat"), (F.size(w) - F.size(F.array_distinct(w))).alias("again")))
    df = docs.withColumns({"_w": per_word, "_l": lines, "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"), "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")})
    df = df.withColumns({"n_words": F.col("_w.n").cast("long"), "n_dup_lines": F.col("_l.dup").cast("long"), "n_repeat_words": F.col("_w.repeat").cast("long")})
    if extra:
        words = F.greatest(F.col("n_words"), F.lit(1))
        chars = F.greatest(F.col("word_chars"), F.lit(1))
        counted = lambda pattern: F.regexp_count(text, F.lit(pattern))
        ratio = lambda n, d: F.floor(1000 * n.cast("long") / d)
        df = df.withColumns({
            "chars_per_100_words": F.floor(100 * F.col("word_chars") / words), "symbols_per_mille": ratio(F.col("n_symbols"), words), "dup_lines_per_mille": ratio(F.col("n_dup_lines"), F.greatest(F.col("_l.n"), F.lit(1))),
            "repeats_per_mille": ratio(F.col("n_repeat_words"), words), "bangs_per_mille": ratio(counted(r"!"), words), "capitals_per_mille": ratio(counted(r"\p{Lu}"), chars), "digits_per_mille": ratio(counted(r"[0-9]"), chars),
            "met_before_per_mille": ratio(F.col("_w.again"), words), "words_per_line": F.floor(words / F.greatest(F.col("_l.n"), F.lit(1))),
        })
    return df.drop("_w", "_l")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass
class DecisionList:
    """Ordered rules; each is a list of (statistic, ">=" or "<", threshold) that all must hold for a document to be bad."""

    rules: list[list[tuple[str, str, int]]] = field(default_factory=list)

    def bad(self) -> Column:
        out = None
        for rule in self.rules:
            holds = _all(rule)
            out = F.when(holds, True) if out is None else out.when(holds, True)
        return F.lit(False) if out is None else out.otherwise(False)


def _all(rule: list[tuple[str, str, int]]) -> Column:
    holds = F.lit(True)
    for name, sign, cut in rule:
        holds = holds & ((F.col(name) >= cut) if sign == ">=" else (F.col(name) < cut))
    return holds


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Statistics and label bad of at most so many labelled documents, stored."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return stored(statistics(rows).select((F.col("_quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) > 0).alias("grow"), *BASE, *[f for f in FEATURES if f not in BASE]), "labelled")


def fit(rows: DataFrame, features: list[str] = FEATURES, most_rules: int = 10, most_tests: int = 3, precision: float = 0.95, least: int = 3) -> DecisionList:
    """rows: columns bad, grow and the features. A rule must reach the precision on both parts together and find `least` bad documents."""
    quantiles = [k / CUTS for k in range(1, CUTS)] + [0.98, 0.99, 0.995]
    spread = rows.agg(*[F.percentile_approx(f, F.array(*map(F.lit, quantiles)), 2000).alias(f) for f in features], *[F.percentile_approx(F.when(F.col("bad"), F.col(f)), F.array(*map(F.lit, quantiles)), 2000).alias(f"bad_{f}") for f in features]).first()
    cuts = {f: sorted({*(spread[f] or []), *(spread[f"bad_{f}"] or []), *(v + 1 for v in spread[f] or [])}) for f in features}
    found, left = DecisionList(), F.lit(True)
    if not any(cuts.values()):
        return found
    # the bins of all rows once: a step then groups small numbers
    rows = stored(rows.withColumn("_bins", F.array(*[F.struct(F.lit(f).alias("f"), _bin(f, cuts[f]).alias("bin")) for f in features if cuts[f]])), "binned")
    for _ in range(most_rules):
        rule = _grow(rows.where(left), features, cuts, most_tests)
        if not rule:
            break
        rule, p, n = _prune(rows.where(left), rule)
        if p < least or p < precision * (p + n):
            break
        found.rules.append(rule)
        left = left & ~_all(rule)
    remove_stored(rows)
    return found


def _bin(f: str, cuts: list[int]) -> Column:
    """How many of the cuts a statistic reaches."""
    return F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col(f)))


def _grow(rows: DataFrame, features: list[str], cuts: dict, most_tests: int) -> list:
    rule: list[tuple[str, str, int]] = []
    for _ in range(most_tests):
        counts = rows.where("grow").where(_all(rule)).select("bad", F.explode("_bins").alias("x")).groupBy("x.f", "x.bin").agg(F.sum(F.col("bad").cast("int")).alias("p"), F.sum((~F.col("bad")).cast("int")).alias("n")).collect()  # statistics x bins
        total = next(((sum(r.p for r in own), sum(r.n for r in own)) for own in [[r for r in counts if r.f == features[0]]]), (0, 0))
        if not total[0] or not total[1]:
            break
        best, gain = None, 1e-9
        for f in features:
            own = {r.bin: (r.p, r.n) for r in counts if r.f == f}
            p = n = 0
            spans: dict[tuple[str, int, int], list[int]] = {}
            for k, cut in enumerate(cuts[f]):
                p, n = p + own.get(k, (0, 0))[0], n + own.get(k, (0, 0))[1]
                spans.setdefault(("<", p, n), []).append(cut)
                spans.setdefault((">=", total[0] - p, total[1] - n), []).append(cut)
            for (sign, a, b), same in spans.items():
                if a and (g := a * (math.log2(a / (a + b)) - math.log2(total[0] / sum(total)))) > gain:
                    best, gain = (f, sign, (same[0] + same[-1] + 1) // 2), g  # the middle of the gap between the kinds
        if not best:
            break
        rule.append(best)
    return rule


def _prune(rows: DataFrame, rule: list) -> tuple[list, int, int]:
    """The shortest prefix of the rule that does best on the other part, and its bad and good documents in both."""
    held = lambda k, kind: F.coalesce(F.sum((_all(rule[:k]) & kind).cast("int")), F.lit(0))
    bad, other = F.col("bad"), ~F.col("grow")
    got = rows.agg(*[c for k in range(1, len(rule) + 1) for c in (held(k, bad & other), held(k, ~bad & other), held(k, bad), held(k, ~bad))]).first()
    each = [got[4 * k : 4 * k + 4] for k in range(len(rule))]
    k = max(range(len(rule)), key=lambda k: ((each[k][0] - each[k][1]) / max(1, each[k][0] + each[k][1]), each[k][0], -k))
    return _tightest(rule[: k + 1]), each[k][2], each[k][3]


def _tightest(rule: list) -> list:
    """The rule without tests that another of its tests implies."""
    out: dict[tuple[str, str], int] = {}
    for name, sign, cut in rule:
        out[name, sign] = (max if sign == ">=" else min)(out.get((name, sign), cut), cut)
    return [(name, sign, cut) for (name, sign), cut in out.items()]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    rows = labelled(docs, labels, sample)
    rules = fit(rows)
    remove_stored(rows)
    return rules


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """docs with the base statistics, base_failed and kept, in one pass without a shuffle."""
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | rules.bad()))


def kept(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The documents that base test and rules keep, with their own columns alone."""
    return judge(nested(docs), rules).where("kept").select("_row.*")
