"""Quality rules: a learned decision list over text statistics, in DataFrame functions only.

Sequential covering: a rule is grown literal by literal (statistic at most / above a threshold) to
separate the bad texts among those that no earlier rule covers, pruned on rows that were kept apart,
and taken if it stays precise there. The rules become one ordered conditional expression. Training
reads a bounded sample of labelled texts; each step of growth is one aggregation that counts every
candidate literal at once, of which only the counts reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import rowmap

SPACE = r"[\x20\x09-\x0D]+"
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "punct_share", "mean_line")


@dataclass(frozen=True)
class RuleSpec:
    """max_rows: expected size of the sample of labelled texts."""

    max_rows: int = 20_000
    thresholds: int = 24
    max_rules: int = 8
    max_literals: int = 3
    min_precision: float = 0.9
    min_covered: int = 5


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def expression(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


def statistics(docs: DataFrame) -> DataFrame:
    """docs less their text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the other statistics.

    A null text has no words, lines or symbols. Shares of nothing are 0. Columns of docs with these
    names are replaced. The arrays stay in the row of their text, so there is no shuffle.
    """
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES}
    kept = [c for c in docs.columns if c.lower() not in made | {"text"}]
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim("_t", F.lit(" \t\n\x0b\x0c\r"))
    df = docs.select(*kept, text.alias("_t")).withColumn("_trim", trimmed)
    df = df.withColumn("_w", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", SPACE))).drop("_trim")
    df = df.withColumn("_n", F.size("_w"))
    df = df.withColumn("_h", F.expr("case when _n >= 8 then transform(sequence(1, _n - 7), i -> xxhash64(slice(_w, i, 8))) else cast(array() as array<bigint>) end"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = reduce(lambda a, b: a + b, [F.length("_t") - F.length(F.replace(F.col("_t"), F.lit(s), F.lit(""))) for s in "#*$%&|<>"])
    only = lambda chars: F.length(F.regexp_replace("_t", f"[^{chars}]+", ""))
    df = df.select(
        *kept,
        "_n",
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"),
        F.length(F.regexp_replace("_t", SPACE, "")).alias("_chars"),
        symbols.alias("_symbols"),
        lines.alias("_lines"),
        F.size(F.array_distinct("_w")).alias("_distinct"),
        only("A-Z").alias("_upper"),
        only(".,;:!?").alias("_punct"),
        F.length("_t").alias("_length"),
    )
    df = df.withColumn("_p", F.expr("case when _s is null then cast(array() as array<int>) else sort_array(transform(filter(_s, (x, i) -> (i > 0 and get(_s, i - 1).h = x.h) or (i + 1 < size(_s) and get(_s, i + 1).h = x.h)), x -> x.i)) end"))
    repeated = F.expr("aggregate(_p, named_struct('last', -8, 'n', 0), (a, p) -> named_struct('last', p, 'n', a.n + least(8, p - a.last)), a -> a.n)")
    df = df.select(*kept, F.col("_n").cast("long").alias("n_words"), F.col("_chars").cast("long").alias("word_chars"), F.col("_symbols").cast("long").alias("n_symbols"), F.size("_lines").alias("_nl"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), repeated.cast("long").alias("n_repeat_words"), "_distinct", "_upper", "_punct", "_length")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return df.select(
        *kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "n_words").alias("symbol_share"), share("n_dup_lines", "_nl").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("_distinct", "n_words").alias("distinct_share"), share("_upper", "_length").alias("upper_share"),
        share("_punct", "n_words").alias("punct_share"), share("_length", "_nl").alias("mean_line"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def labelled_statistics(docs: DataFrame, labels: DataFrame, spec: RuleSpec) -> DataFrame:
    """Statistics of a sample of labelled texts with `bad` (quality 0 in any of its labels), chosen by a hash of doc_id."""
    flags = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    rate = min(1.0, spec.max_rows / max(1, flags.count()))
    chosen = flags.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003)) < rate * 1_000_003)
    # the sample is bounded by the specification, and so may be broadcast
    return statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def fit(sample: DataFrame, spec: RuleSpec = RuleSpec()) -> list[list[Literal]]:
    """The conjunctions of an ordered list whose verdict is bad; a text that none covers is good.

    sample: the FEATURES and `bad`, for the texts that the list is to judge. No rules come of a sample
    without bad texts. Ties go to the earlier feature and the smaller threshold.
    """
    marks = [i / (spec.thresholds + 1) for i in range(1, spec.thresholds + 1)]
    # exact, so that the list doesn't depend on how the bounded sample is partitioned
    cuts_of = sample.groupBy("bad").agg(*[F.percentile(f, F.array(*[F.lit(m) for m in marks])).alias(f) for f in FEATURES]).collect()
    if not any(r["bad"] for r in cuts_of):
        return []
    # values half-way between quantiles of either class, so that no threshold is a value of one of them
    cuts = {}
    for f in FEATURES:
        values = sorted({v for r in cuts_of for v in r[f] or []})
        cuts[f] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    binned = sample.select("bad", (F.pmod(F.xxhash64(*FEATURES, F.lit(1)), F.lit(3)) == 0).alias("apart"), *[_bin(f, cuts[f]).alias(f) for f in FEATURES])
    binned = rowmap.written(binned.groupBy("bad", "apart", *FEATURES).count(), "binned")
    rules: list[list[tuple[str, bool, int]]] = []
    left = F.lit(True)
    while len(rules) < spec.max_rules:
        rule, stages = [], []
        inside = left
        while len(rule) < spec.max_literals:
            table = _histogram(binned.where(inside))
            p0, n0 = (sum(table.get((FEATURES[0], i, False, bad), 0) for i in range(len(cuts[FEATURES[0]]) + 1)) for bad in (True, False))
            if p0 < spec.min_covered or (rule and n0 == 0):
                break
            best = None
            for f in FEATURES:
                for above in (False, True):
                    at = {key: 0 for key in ((False, True), (False, False), (True, True), (True, False))}
                    steps = range(len(cuts[f])) if not above else range(len(cuts[f]) - 1, -1, -1)
                    for i in steps:
                        for apart, bad in at:
                            at[apart, bad] += table.get((f, i + 1 if above else i, apart, bad), 0)
                        gain = _gain(at[False, True], at[False, False], p0, n0)
                        if at[False, True] >= spec.min_covered and gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, (f, above, i), dict(at))
            if best is None:
                break
            rule.append(best[1])
            stages.append(best[2])
            inside = inside & _binned_literal(*best[1])
        value = lambda s: (s[True, True] - s[True, False]) / max(1, s[True, True] + s[True, False])
        if not rule:
            break
        size = max(range(len(rule)), key=lambda k: (value(stages[k]), -k)) + 1
        rule, at = rule[:size], stages[size - 1]
        bad, good = at[True, True] + at[False, True], at[True, False] + at[False, False]
        if bad < spec.min_precision * (bad + good) or value(at) < 2 * spec.min_precision - 1:
            break
        rules.append(rule)
        left = left & ~reduce(lambda a, b: a & b, [_binned_literal(*x) for x in rule])
    return [[Literal(f, above, cuts[f][i]) for f, above, i in rule] for rule in rules]


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many of the cuts the value is above."""
    return reduce(lambda a, b: a + b, [(F.col(feature) > F.lit(c)).cast("int") for c in cuts], F.lit(0))


def _binned_literal(feature: str, above: bool, cut: int) -> Column:
    return F.col(feature) > cut if above else F.col(feature) <= cut


def _histogram(binned: DataFrame) -> dict:
    """Rows by (feature, bin, kept apart, bad)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES]))
    rows = binned.select("bad", "apart", "count", pairs.alias("x")).groupBy("x.f", "x.b", "apart", "bad").agg(F.sum("count").alias("n")).collect()
    return {(r["f"], r["b"], r["apart"], r["bad"]): r["n"] for r in rows}


def rule_number(rules: list[list[Literal]]) -> Column:
    """The number of the first rule that covers a row, from 1; 0 if none does."""
    if not rules:
        return F.lit(0)
    whole = F
    for i, rule in enumerate(rules, 1):
        whole = whole.when(reduce(lambda a, b: a & b, [x.expression() for x in rule]), i)
    return whole.otherwise(0)


def judge(docs: DataFrame, rules: list[list[Literal]]) -> DataFrame:
    """statistics(docs) with base_failed, rule (its number, 0 for none) and kept.

    A null or empty text fails for want of words; texts are read whole; repeated rows are judged alike; an
    empty table stays empty; columns with these names, in any case, are replaced.
    """
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", rule_number(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs, spec = rowmap.documents(spark, sf_dir), RuleSpec()
    sample = rowmap.written(labelled_statistics(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), spec), "labelled")
    rules = fit(sample.where(~base_failed()), spec)
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
