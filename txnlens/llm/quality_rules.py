"""Quality rules: a decision list learnt by sequential covering, applied as one conditional expression.

Everything runs as DataFrame expressions. A text is read once, into a narrow table of counts (``measures``). The list
is learnt from the labelled rows of that table: each step of growing a rule is one aggregate (rows by measure, threshold
bin, label and part), whose size depends on the number of measures and thresholds and not on the data. The learnt list
is a chain of ``when`` over the measures.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.llm.common import WORD, chars_in, held_out, let, words_of
from txnlens.sources.scratch import stored

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "exclamations_per_word": "n_exclaim / greatest(n_words, 1)",
    "bars_per_word": "n_bars / greatest(n_words, 1)",
}


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the same text.

    Windows are sorted by a 64-bit hash with their place, so that equal ones are neighbours: n log n for any text.
    """

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def marked(s: Column) -> Column:
        same = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def windows(w: Column) -> Column:
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows(words), marked))


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts and the ratios that rules test, one row per row of ``docs``.

    A null text counts as empty: all counts 0. Other columns of ``docs`` are ignored, whatever their names.
    """
    return measures_of(docs.select("doc_id", "text"), F.col("text"), "doc_id")


def measures_of(rows: DataFrame, text: Column, carried: str) -> DataFrame:
    """The counts and ratios of ``text``, beside one column that is carried along."""
    rows = rows.select(F.col(carried), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    t = F.col("text")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    out = rows.select(
        carried,
        let(words_of(t), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r"))).alias("w"),
        (F.length(t) - F.length(F.regexp_replace(t, WORD, ""))).alias("word_chars"),
        chars_in(t, "#*$%&|<>").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("l"),
        chars_in(t, "A-Z").alias("n_upper"), chars_in(t, "0-9").alias("n_digits"),
        chars_in(t, "!").alias("n_exclaim"), chars_in(t, "|").alias("n_bars"),
    ).selectExpr(
        carried, "w.n AS n_words", "word_chars", "n_symbols", "l.n - l.d AS n_dup_lines", "w.r AS n_repeat_words",
        "l.n AS n_lines", "n_upper", "n_digits", "n_exclaim", "n_bars",
    )
    return out.selectExpr(
        carried, *[f"CAST({c} AS BIGINT) AS {c}" for c in COUNTS], *[f"{e} AS {n}" for n, e in RATIOS.items()],
    )


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    """A conjunction; rows that meet it are rejected."""

    conditions: tuple[Condition, ...]
    precision: float
    support: int

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that a row meets, null if it meets none."""
    out = F.lit(None).cast("int")
    for number in range(len(rules), 0, -1):
        out = F.when(F.expr(rules[number - 1].sql()), F.lit(number)).otherwise(out)
    return out


def _thresholds(rows: DataFrame, bins: int) -> list[list[float]]:
    """Per measure, the middles between neighbouring quantiles (least and greatest included) of both classes.

    Middles, since a cut at the last good value would reject whatever lies barely beyond what was seen.
    """
    shares = [i / bins for i in range(bins + 1)]
    of = [F.percentile_approx(F.when(cond, F.col(m)), shares, 2000).alias(f"{m}_{k}")
          for m in RATIOS for k, cond in (("good", ~F.col("bad")), ("bad", F.col("bad")))]
    got = rows.agg(*of).first()
    out = []
    for m in RATIOS:
        seen = sorted({float(x) for k in ("good", "bad") for x in got[f"{m}_{k}"] or [] if math.isfinite(x)})
        out.append([(a + b) / 2 for a, b in zip(seen, seen[1:])])
    return out


def _bin(value: Column, edges: list[float]) -> Column:
    """Number of cut points below the value."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < value)) if edges else F.lit(0)


def _counts(rows: DataFrame) -> dict[tuple[bool, int, int], tuple[int, int]]:
    """(part, measure, bin) -> (rejected, good) rows."""
    got = (rows.select("bad", "prune", F.posexplode("bins").alias("m", "bin"))
           .groupBy("prune", "m", "bin").agg(F.sum(F.col("bad").cast("int")), F.sum((~F.col("bad")).cast("int"))).collect())
    return {(r[0], r[1], r[2]): (r[3], r[4]) for r in got}


def _best(counts: dict, cuts: list[list[float]], pos: int, neg: int) -> tuple[float, int, bool, int]:
    """The condition with the largest information gain: (gain, measure, above, cut number)."""
    before = math.log2((pos + 1) / (pos + neg + 2))
    best = (0.0, -1, False, -1)
    for m, edges in enumerate(cuts):
        p = n = 0
        for cut in range(len(edges)):
            dp, dn = counts.get((False, m, cut), (0, 0))
            p, n = p + dp, n + dn
            for above, a, b in ((False, p, n), (True, pos - p, neg - n)):
                gain = a * (math.log2((a + 1) / (a + b + 2)) - before)
                if gain > best[0] + 1e-9:
                    best = (gain, m, above, cut)
    return best


def learn_rules(
    labelled: DataFrame, *, bins: int = 16, max_rules: int = 8, max_conditions: int = 4, min_precision: float = 0.9,
    min_support: int = 5,
) -> list[Rule]:
    """Sequential covering over rows with the measures, ``bad`` (boolean) and ``prune`` (boolean).

    A rule grows by the condition of largest gain on the growing part and is then cut back to the prefix that does
    best on the pruning part; it is accepted if its precision there is high enough. Rows it covers leave both parts,
    and the next rule grows on the rest. No labelled rows, or no rejected ones: no rules.
    """
    cuts = _thresholds(labelled, bins)
    binned = [_bin(F.col(m), edges) for m, edges in zip(RATIOS, cuts, strict=True)]
    table = stored(labelled.select("bad", "prune", F.array(*binned).alias("bins")), "rule-bins")
    rules: list[Rule] = []
    left = table
    while len(rules) < max_rules:
        inside, chosen, states = left, [], []
        while True:
            counts = _counts(inside)
            total = {part: [sum(v[k] for (q, m, _), v in counts.items() if q == part and m == 0) for k in (0, 1)]
                     for part in (False, True)}
            states.append(total[True])
            pos, neg = total[False]
            if len(chosen) == max_conditions or pos < min_support or neg == 0:
                break
            gain, m, above, cut = _best(counts, cuts, pos, neg)
            if m < 0:
                break
            chosen.append((m, above, cut))
            inside = inside.where(_meets(m, above, cut))
        worth = [((p - n) / (p + n) if p + n else -1.0) for p, n in states]
        keep = max(range(1, len(worth)), key=lambda k: (worth[k], -k), default=0)
        if not keep or states[keep][0] < min_support or states[keep][0] < min_precision * sum(states[keep]):
            break
        p, n = states[keep]
        names = list(RATIOS)
        rules.append(Rule(tuple(Condition(names[m], a, cuts[m][c]) for m, a, c in chosen[:keep]), p / (p + n), p))
        for_all = F.lit(True)
        for c in chosen[:keep]:
            for_all = for_all & _meets(*c)
        left = left.where(~for_all)
    return rules


def _meets(m: int, above: bool, cut: int) -> Column:
    b = F.get(F.col("bins"), F.lit(m))
    return b > cut if above else b <= cut


def labelled_measures(table: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``table`` that have a quality label and are not held out; a third is for pruning."""
    known = labels.select(labels["doc_id"].alias("doc_id"), (labels["quality"] == 0).alias("bad"))
    rows = table.where(~F.expr(BASE_FAILED)).join(known.where("bad IS NOT NULL"), "doc_id")
    return rows.where(~held_out(F.col("doc_id"))).withColumn("prune", F.xxhash64(F.lit("prune"), F.col("doc_id")) % 3 == 0)


def apply_rules(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The measures of each row of ``docs`` with ``base_failed``, ``rule`` (number, null if none) and ``kept``."""
    table = stored(measures(docs), "quality-measures")
    rules = learn_rules(labelled_measures(table, labels), **settings)
    return (table.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rule", verdict(rules))
            .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()))


def keep(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the base rules and the learnt list keep.

    The list is learnt from the measures of these rows; the second reading of the texts applies it where they are, so
    that no text is moved.
    """
    rules = learn_rules(labelled_measures(stored(measures(docs), "quality-measures"), labels), **settings)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    kept = measures_of(whole, F.col("doc.text"), "doc").where(~F.expr(BASE_FAILED)).where(verdict(rules).isNull())
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
