"""Quality rules: learned decision lists over text statistics, in DataFrame operations only.

Statistics of every whole text are Spark expressions. Sequential covering learns, from a bounded sample of labelled documents,
rules for rejected documents: a rule grows threshold by threshold (the best FOIL gain on two thirds of the sample), is pruned on the other third,
and covered documents leave before the next one. The list becomes one ordered conditional expression.

Defined results: a null text has no words; texts under MIN_WORDS words or with over MAX_REPEAT_PERCENT of their words in repeated windows fail the base rules.
Labels with a null doc_id or quality are left out; if labels conflict or repeat, each counts; with no usable labels the list is empty and
only base rules hold. Rows are kept one for one; no step shuffles texts; very long texts are worked on whole; clashing columns are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cloakframe.llm.common import NOT_WHITE, WHITE, table

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Labelled rows that learning reads at most: those with the smallest hash of their id.
SAMPLE = 3000
#: A rule must be this right on documents it was not grown on, and cover so many.
PRECISION, COVER, RULES = 0.97, 5, 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("symbol_ratio", "repeat_ratio", "dup_line_ratio", "mean_word", "upper_ratio", "mark_ratio", "digit_ratio", "line_words")


def _let(value: str, name: str, body: str) -> str:
    """SQL in which value is computed once and body uses it by name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base statistics and ratios of its text column (clashing columns are replaced)."""
    docs = docs.drop(*BASE, *RATIOS, "base_failed")
    names = docs.columns
    t = "coalesce(cast(__t as string), '')"
    ws, not_ws = WHITE.replace("\\", "\\\\"), NOT_WHITE.replace("\\", "\\\\")
    gone = lambda pattern: f"char_length({t}) - char_length(regexp_replace({t}, '{pattern}', ''))"
    windows = f"CASE WHEN size(h) >= {WINDOW} THEN transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({', '.join(f'get(h, i + {k})' for k in range(WINDOW))})) ELSE array() END"
    starts = "sort_array(filter(transform(s, (x, i) -> CASE WHEN x.h = get(s, i - 1).h OR x.h = get(s, i + 1).h THEN x.p END), p -> p IS NOT NULL))"
    spread = f"aggregate(transform(p, (x, k) -> least({WINDOW}, coalesce(get(p, k + 1) - x, {WINDOW}))), 0, (a, b) -> a + b)"
    repeated = _let("sort_array(transform(g, (x, i) -> struct(x AS h, i AS p)))", "s", _let(starts, "p", spread))
    lines = f"filter(split({t}, '\\n'), l -> l rlike '{not_ws}')"
    out = docs.withColumn("__t", F.col(f"`{text}`"))
    out = out.withColumn("__words", F.expr(f"split(regexp_replace({t}, '^{ws}+|{ws}+$', ''), '{ws}+')"))
    out = out.selectExpr(
        "*",
        "CASE WHEN get(__words, 0) = '' THEN 0 ELSE size(__words) END AS __n",
        _let("transform(__words, w -> xxhash64(w))", "h", _let(windows, "g", f"CASE WHEN size(array_distinct(g)) < size(g) THEN {repeated} ELSE 0 END")) + " AS __repeat",
        f"char_length({t}) AS __chars",
        f"{gone(ws + '+')} AS __white",
        f"char_length(regexp_replace({t}, '[^#*$%&|<>]+', '')) AS __symbols",
        f"char_length(regexp_replace({t}, '[^A-Z]+', '')) AS __upper",
        f"char_length(regexp_replace({t}, '[^!?]+', '')) AS __marks",
        f"char_length(regexp_replace({t}, '[^0-9]+', '')) AS __digits",
        _let(lines, "l", "struct(size(l) AS n, size(l) - size(array_distinct(l)) AS d)") + " AS __lines",
    )
    n, chars = "greatest(__n, 1)", "greatest(__chars - __white, 1)"
    return out.selectExpr(
        *[f"`{c}`" for c in names],
        "cast(__n as long) AS n_words", "cast(__chars - __white as long) AS word_chars", "cast(__symbols as long) AS n_symbols",
        "cast(__lines.d as long) AS n_dup_lines", "cast(__repeat as long) AS n_repeat_words",
        f"__symbols / {chars} AS symbol_ratio", f"__repeat / {n} AS repeat_ratio", "__lines.d / greatest(__lines.n, 1) AS dup_line_ratio",
        f"(__chars - __white) / {n} AS mean_word", f"__upper / {chars} AS upper_ratio", f"__marks / {chars} AS mark_ratio", f"__digits / {chars} AS digit_ratio", "__n / greatest(__lines.n, 1) AS line_words",
        f"(__n < {MIN_WORDS} OR 100 * __repeat > {MAX_REPEAT_PERCENT} * __n) AS base_failed",
    )


Rule = list[tuple[str, str, float]]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(np.logical_and, [(x[f] >= v) if op == ">=" else (x[f] <= v) for f, op, v in rule], np.ones(n, bool))


def _grow(x: dict[str, np.ndarray], y: np.ndarray, rows: np.ndarray) -> Rule:
    """Adds the threshold of best FOIL gain until only rejected rows are covered or nothing gains."""
    rule: Rule = []
    live = rows.copy()
    while len(rule) < 4:
        p, n = int(y[live].sum()), int((~y[live]).sum())
        if not p or not n:
            break
        best: tuple[float, tuple[str, str, float] | None] = (1e-9, None)
        for f in sorted(x):
            values = x[f][live]
            order = np.argsort(values, kind="stable")
            ordered, hits = values[order], y[live][order]
            ends = np.flatnonzero(np.diff(ordered))  # a threshold lies between different values only
            if not len(ends):
                continue
            up_to = np.cumsum(hits)[ends]
            counts = ends + 1
            for op, pos, size in (("<=", up_to, counts), (">=", p - up_to, len(ordered) - counts)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pos > 0, pos * (np.log2(pos / size) - np.log2(p / (p + n))), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    middle = float((ordered[ends[k]] + ordered[ends[k] + 1]) / 2)
                    best = (float(gain[k]), (f, op, middle))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= _covers([best[1]], x, len(y))
    return rule


def learn(x: dict[str, np.ndarray], y: np.ndarray) -> list[Rule]:
    """Ordered rules for rejected rows (y true), by sequential covering with reduced-error pruning."""
    n = len(y)
    held = np.arange(n) % 3 == 2
    left, rules = np.ones(n, bool), []
    while len(rules) < RULES:
        rule = _grow(x, y, left & ~held)

        def worth(r: Rule) -> float:
            at = _covers(r, x, n) & left & held
            p, q = int(y[at].sum()), int((~y[at]).sum())
            return (p - q) / (p + q) if p + q else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        at = _covers(rule, x, n) & left
        tested = at & held
        if not rule or at.sum() < COVER or not tested.any() or y[at].mean() < PRECISION or y[tested].mean() < PRECISION:
            break
        rules.append(rule)
        left &= ~at
    return rules


def as_expression(rules: list[Rule]) -> Column:
    """1, 2, ...: the first rule that rejects a row; 0: none does."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(reduce(lambda a, b: a & b, [(F.col(f) >= v) if op == ">=" else (F.col(f) <= v) for f, op, v in rule]), i).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from at most `sample` labelled documents that pass the base rules."""
    drawn = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias("__id"), F.col("quality").alias("__q")).orderBy(F.xxhash64("__id"), "__id", "__q").limit(sample)
    some = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("__id"))
    # base_failed is looked at here: as a filter it would move below the join and be computed for every document
    rows = sorted((r for r in statistics(some).select("doc_id", "__q", *RATIOS, "base_failed").collect() if not r["base_failed"]), key=tuple)
    if not rows:
        return []
    x = {f: np.array([float(r[f]) for r in rows]) for f in RATIOS}
    return learn(x, np.array([r["__q"] == 0 for r in rows]))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with its statistics, base_failed, rule (the number of the rule that rejects it, or 0) and kept."""
    rules = fit(docs, labels)
    return statistics(docs.drop("rule", "kept")).withColumn("rule", as_expression(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, table(spark, sf_dir, "labels")).select("doc_id", *BASE, "base_failed", "kept", "rule")


QUERIES = {"op8_quality": op8_quality}
ORACLE_SQL: dict[str, str] = {}
