"""Quality rules: document statistics, and learned decision lists over them.

Statistics are computed inside a row by built-in functions: no shuffle, no Python. A decision list is learned from
labelled statistics by sequential covering: a conjunction of thresholds is grown to cover bad documents and few good
ones, pruned on rows kept apart for that, emitted, and what it covers is set aside before the next one is grown. The
list is returned as rules and as one ordered Spark conditional expression. Only DataFrame functions touch rows; the
search itself runs over a contingency table that the sample's bound limits.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, materialise

#: Labelled rows that a decision list is learned from, at most.
SAMPLE = 20_000
WINDOW = 5
_WS = " \t\n\x0b\f\r"
FEATURES = ("mean_word", "symbols", "dup_lines", "repeats", "upper", "bangs", "distinct")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return F.coalesce(c > self.threshold if self.above else c <= self.threshold, F.lit(False))


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and FEATURES.

    Words are ``[^\\x20\\x09-\\x0D]+``. A null text counts as an empty one: all counts 0, ratios 0. Windows are compared
    by 64-bit hashes inside one document.
    """
    keep = [c for c in docs.columns if c != text and not c.startswith("__")]
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    d = d.withColumn("__s", F.trim(F.col("__t"), F.lit(_WS)))
    d = d.withColumn("__w", F.when(F.col("__s") == "", F.array().cast("array<string>")).otherwise(F.split("__s", r"[\x20\x09-\x0D]+")))
    d = d.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    d = d.withColumn("n_words", F.size("__w").cast("long"))
    window = "xxhash64(" + ",".join(f"__h[i+{k}]" if k else "__h[i]" for k in range(WINDOW)) + ")"
    d = d.withColumn("__x", F.expr(f"if(n_words >= {WINDOW}, transform(sequence(0, cast(n_words as int) - {WINDOW}), i -> {window}), cast(array() as array<bigint>))"))
    d = d.withColumn("__dup", F.size(F.array_distinct("__x")) < F.size("__x"))
    d = d.withColumn("__y", F.expr("if(__dup, sort_array(transform(__x, (h, i) -> struct(h, i))), null)"))
    d = d.withColumn("__p", F.expr(
        "if(__dup, sort_array(array_distinct(flatten(zip_with(slice(__y, 1, size(__y) - 1), slice(__y, 2, size(__y) - 1),"
        " (a, b) -> if(a.h = b.h, array(a.i, b.i), cast(array() as array<int>)))))), null)"))
    d = d.withColumn("n_repeat_words", F.expr(
        f"if(__dup, aggregate(zip_with(slice(__p, 1, size(__p) - 1), slice(__p, 2, size(__p) - 1), (a, b) -> least({WINDOW}, b - a)),"
        f" cast({WINDOW} as bigint), (acc, x) -> acc + x), 0L)"))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.trim(x, F.lit(_WS)) != "")
    d = d.withColumn("__l", lines)
    less = lambda chars, of="__t": (F.length(of) - F.length(F.translate(F.col(of), chars, ""))).cast("long")
    d = d.withColumn("word_chars", F.length(F.translate(F.col("__s"), _WS, "")).cast("long"))
    d = d.withColumn("n_symbols", less("#*$%&|<>")).withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n, chars = F.col("n_words"), F.col("word_chars")
    return d.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ratio(chars, n).alias("mean_word"), ratio(F.col("n_symbols"), n).alias("symbols"), ratio(F.col("n_dup_lines"), F.size("__l")).alias("dup_lines"),
        ratio(F.col("n_repeat_words"), n).alias("repeats"), ratio(less("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "__s"), chars).alias("upper"),
        ratio(less("!", "__s"), n).alias("bangs"), ratio(F.size(F.array_distinct("__h")), n).alias("distinct"),
    )


def contingency(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE, bins: int = 24) -> tuple[dict[str, list[float]], list[tuple]]:
    """Thresholds by feature, and (bins, held out, label, count) of at most ``sample`` labelled rows.

    Labels are ``doc_id`` and ``quality`` (1 good, 0 bad); rows without either are left out. Beyond ``sample`` rows,
    those under a bound by a hash of doc_id are taken.
    """
    lab = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    rows = stats.where("doc_id is not null").select("doc_id", *FEATURES).join(lab, "doc_id")
    rows = materialise(hashed_sample(rows, sample, "doc_id").withColumn("__o", F.xxhash64("doc_id", F.lit(5))))
    at = [i / bins for i in range(1, bins)]
    quantiles = rows.groupBy("y").agg(*(F.percentile_approx(f, at, 2000).alias(f) for f in FEATURES)).collect()
    thresholds = {f: sorted({0.0, *(v for r in quantiles for v in r[f] or ())}) for f in FEATURES}
    binned = rows.select(
        F.array(*(sum((F.when(F.col(f) > t, 1).otherwise(0) for t in thresholds[f]), F.lit(0)) for f in FEATURES)).alias("b"),
        (F.pmod("__o", F.lit(3)) == 0).alias("apart"), "y",
    )
    return thresholds, [(tuple(r.b), r.apart, r.y, r.n) for r in binned.groupBy("b", "apart", "y").agg(F.count("*").alias("n")).collect()]


def learn(thresholds: dict[str, list[float]], table: list[tuple], precision: float = 0.98, least: int = 8, most_rules: int = 8, most_conditions: int = 3) -> list[Rule]:
    """Sequential covering over a contingency table; rules that reject, in order.

    A rule must keep ``precision`` on the rows it grew from and on the rows kept apart, and cover ``least`` of the former.
    """
    holds = lambda b, c: all((b[f] > k) if up else (b[f] <= k) for f, up, k in c)

    def value(c, rows):
        bad = good = 0
        for b, _, y, n in rows:
            if holds(b, c):
                bad, good = (bad + n, good) if y == 0 else (bad, good + n)
        return bad, good

    rules: list[Rule] = []
    left = list(table)
    while len(rules) < most_rules:
        grow, apart = [r for r in left if not r[1]], [r for r in left if r[1]]
        conj: tuple = ()
        inside, score = grow, -1.0
        while len(conj) < most_conditions:
            best = None
            for f in range(len(FEATURES)):
                count: dict = defaultdict(Counter)
                for b, _, y, n in inside:
                    count[b[f]][y] += n
                total = Counter()
                for c in count.values():
                    total.update(c)
                low = Counter()
                for k in sorted(count)[:-1]:
                    low.update(count[k])
                    for up, bad, good in ((False, low[0], low[1]), (True, total[0] - low[0], total[1] - low[1])):
                        if bad >= least:
                            s = (bad + 1) / (bad + good + 2) + 1e-4 * bad / (1 + total[0])
                            if best is None or s > best[0]:
                                best = (s, (f, up, k))
            if best is None or best[0] <= score + 1e-6:
                break
            score, conj = best[0], (*conj, best[1])
            inside = [r for r in inside if holds(r[0], conj[-1:])]
        if not conj:
            break

        def rate(c, rows):
            bad, good = value(c, rows)
            return (bad + 1) / (bad + good + 2)

        while len(conj) > 1 and (shorter := max((tuple(x for x in conj if x != c) for c in conj), key=lambda c: rate(c, apart))) and rate(shorter, apart) >= rate(conj, apart):
            conj = shorter
        bad, good = value(conj, grow)
        bad_apart, good_apart = value(conj, apart)
        if bad < least or bad < precision * (bad + good) or bad_apart < precision * (bad_apart + good_apart):
            break
        rules.append(Rule(tuple(Condition(FEATURES[f], up, _edge(thresholds[FEATURES[f]], k)) for f, up, k in conj), bad, bad / (bad + good)))
        left = [r for r in left if not holds(r[0], conj)]
    return rules


def _edge(thresholds: list[float], k: int) -> float:
    """Bin k holds values above ``thresholds[k - 1]`` up to ``thresholds[k]``: more than bin k is more than the latter."""
    return thresholds[k] if k < len(thresholds) else float("inf")


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: number of the first rule that rejects a row, from 1, or null."""
    out = None
    for i, r in enumerate(rules, 1):
        out = F.when(r.column(), F.lit(i)) if out is None else out.when(r.column(), F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Statistics of every document, base_failed, rule (the first that rejects it) and kept.

    Defined cases: a null or empty text has no words and fails the base; a null doc_id is judged like any other but
    never learned from; repeated rows are judged alike; without labels (or with an empty table) the list is empty and
    the base alone decides; columns of ``docs`` besides doc_id and text are ignored.
    """
    stats = materialise(statistics(docs.select("doc_id", "text")))
    rules = learn(*contingency(stats, labels, sample))
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
