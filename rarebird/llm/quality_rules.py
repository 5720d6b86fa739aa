"""Learned decision lists over statistics of a text.

Statistics are counted per text on the executors. A decision list is learned from
labelled statistics by sequential covering: grow a conjunction of thresholds that
separates label 0 from label 1, prune it on rows it was not grown on, keep it if
it is precise enough on both, remove what it covers, go on. The list becomes one
ordered Spark conditional expression, so judging rows needs no Python.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarebird.llm.common import free_name, words

# Characters counted as symbols, and the base rules' limits.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# End of the fixed values.
#: Labelled rows a list is learned from at most: those with the smallest MD5 of
#: their id. All labelled rows, if fewer.
MAX_TRAINING_ROWS = 100_000
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_distinct_words",
    "n_same_words",
    "n_upper",
    "n_digits",
    "n_marks",
    "n_bytes",
)


def repeated_words(found: list) -> int:
    """Words in 3-word windows that occur twice or more in the text, the first included."""
    windows = list(zip(found, found[1:], found[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered = end = 0
    for i, window in enumerate(windows):
        if often[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts named in COUNTS."""
    found = words(text)
    if not found:
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        return (0, 0, 0, 0, 0, raw.count(b"\n") + 1, 0, 0, 0, 0, 0, len(raw))
    raw = text.encode("utf-8", "surrogatepass")
    solid = b"".join(found)
    lines = raw.split(b"\n")
    full = lines if len(lines) == 1 else [line for line in lines if line.strip()]
    n = len(solid)
    without = lambda some: n - len(solid.translate(None, some))
    return (
        len(found),
        n if n == len(raw) or solid.isascii() else len(solid.decode("utf-8", "surrogatepass")),
        without(SYMBOLS),
        len(full) - len(set(full)),
        repeated_words(found),
        len(lines),
        len(set(found)),
        sum(map(eq, found, found[1:])),
        without(_UPPER),
        without(_DIGITS),
        without(_MARKS),
        len(raw),
    )


def _measure(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(t) for t in texts.tolist()], columns=list(COUNTS), dtype="int64")


def with_statistics(docs: DataFrame, text: str = "text", into: str = "stats") -> DataFrame:
    """All rows and columns, and ``into``, a struct of counts; a null text has the counts of an empty one."""
    measure = F.pandas_udf(_measure, ", ".join(f"{c} long" for c in COUNTS))
    return docs.withColumn(into, measure(F.col(text).cast("string")))


def base_failed(stats: str) -> Column:
    n, repeated = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)


def features(stats: str) -> dict[str, Column]:
    """The quantities that rules set thresholds on; shares of nothing are 0."""
    c = {name: F.col(f"{stats}.{name}").cast("double") for name in COUNTS}
    share = lambda a, b: F.coalesce(c[a] / F.nullif(c[b], F.lit(0.0)), F.lit(0.0))
    return {
        "words": c["n_words"],
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "same_share": share("n_same_words", "n_words"),
        "distinct_share": share("n_distinct_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "words_per_line": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Threshold:
    feature: str
    above: bool
    value: float

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        x = columns[self.feature]
        return x > self.value if self.above else x <= self.value

    def column(self, columns: dict[str, Column]) -> Column:
        x = columns[self.feature]
        return x > F.lit(self.value) if self.above else x <= F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:.6g}"


@dataclass(frozen=True)
class Rule:
    """Rows for which all thresholds hold have label 0."""

    conditions: tuple[Threshold, ...]

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.holds(columns) for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; a row that none covers is kept."""

    rules: tuple[Rule, ...]

    def kept(self, columns: dict[str, Column]) -> Column:
        """``CASE WHEN rule 1 THEN false WHEN rule 2 THEN false ... ELSE true END``."""
        verdict = F
        for rule in self.rules:
            holds = rule.conditions[0].column(columns)
            for c in rule.conditions[1:]:
                holds = holds & c.column(columns)
            verdict = verdict.when(holds, F.lit(False))
        return verdict.otherwise(F.lit(True)) if self.rules else F.lit(True)

    def __str__(self) -> str:
        return "\n".join([*(f"reject if {r}" for r in self.rules), "keep otherwise"])


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    """FOIL's information gain of going from p0, n0 covered rows to p, n."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)


def _grow(columns: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> list[Threshold]:
    rows = np.arange(len(bad))
    conditions: list[Threshold] = []
    while len(conditions) < longest and bad[rows].any() and not bad[rows].all():
        best, best_gain = None, 1e-9
        here = bad[rows]
        p0, n0 = int(here.sum()), int((~here).sum())
        for name, column in columns.items():
            x = column[rows]
            order = np.argsort(x, kind="stable")
            xs, p = x[order], np.cumsum(here[order])
            n = np.arange(1, len(xs) + 1) - p
            cut = np.flatnonzero(xs[:-1] < xs[1:])
            for above, pc, nc in ((False, p[cut], n[cut]), (True, p0 - p[cut], n0 - n[cut])):
                if len(cut):
                    gains = _gain(pc, nc, p0, n0)
                    k = int(np.argmax(gains))
                    if gains[k] > best_gain:
                        value = float((xs[cut[k]] + xs[cut[k] + 1]) / 2)
                        best, best_gain = Threshold(name, above, value), gains[k]
        if best is None:
            break
        conditions.append(best)
        rows = rows[best.holds({best.feature: columns[best.feature][rows]})]
    return conditions


def _prune(conditions: list[Threshold], columns: dict[str, np.ndarray], bad: np.ndarray) -> list[Threshold]:
    """The leading conditions that do best on rows the rule was not grown on."""

    def worth(some: list[Threshold]) -> float:
        held = Rule(tuple(some)).holds(columns)
        p, n = int((held & bad).sum()), int((held & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((conditions[:k] for k in range(len(conditions), 0, -1)), key=worth)


def learn(
    columns: dict[str, np.ndarray],
    bad: np.ndarray,
    min_precision: float = 0.95,
    min_covered: int = 5,
    longest: int = 4,
    most_rules: int = 20,
) -> DecisionList:
    """A decision list by sequential covering.

    Every third row prunes, the others grow. A rule is kept if at least
    ``min_covered`` rows of label 0 fall under it and ``min_precision`` of all
    it covers are of label 0; the first that isn't ends the list, as does the
    lack of either label.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    prunes = np.arange(len(bad)) % 3 == 2
    while len(rules) < most_rules:
        take = lambda mask: {k: v[mask] for k, v in columns.items()}
        grow, check = left & ~prunes, left & prunes
        conditions = _grow(take(grow), bad[grow], longest)
        if not conditions:
            break
        rule = Rule(tuple(_prune(conditions, take(check), bad[check])))
        held = rule.holds(columns) & left
        p, n = int((held & bad).sum()), int((held & ~bad).sum())
        if p < min_covered or p < min_precision * (p + n):
            break
        rules.append(rule)
        left &= ~held
    return DecisionList(tuple(rules))


def fit(
    measured: DataFrame,
    labels: DataFrame,
    stats: str = "stats",
    id_column: str = "doc_id",
    label: str = "quality",
    max_rows: int = MAX_TRAINING_ROWS,
) -> DecisionList:
    """Learn from the labelled rows that pass the base rules.

    ``measured`` has ids and statistics. Rows without id or label, and labels
    other than 0 and 1, are not learned from; without labels the list is empty
    and keeps every row. At most ``max_rows`` rows reach the driver.
    """
    return _learned(_training_rows(measured, labels, stats, id_column, label, max_rows))


def _known(labels: DataFrame, id_column: str, label: str) -> DataFrame:
    """id and label of each labelled id."""
    return (
        labels.filter(F.col(label).isin(0, 1) & F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).alias("id"))
        .agg(F.min(label).alias("label"))
    )


def _training_rows(measured: DataFrame, labels: DataFrame, stats: str, id_column: str, label: str, max_rows: int) -> pd.DataFrame:
    values = features(stats)
    return (
        measured.filter(~base_failed(stats))
        .select(F.col(id_column).alias("id"), *(v.alias(k) for k, v in values.items()))
        .join(_known(labels, id_column, label), "id")
        .orderBy(F.md5(F.col("id").cast("string")), *values)
        .limit(max_rows)
        .toPandas()
    )


def _learned(rows: pd.DataFrame) -> DecisionList:
    return learn({k: rows[k].to_numpy(float) for k in rows.columns if k not in ("id", "label")}, rows["label"].to_numpy() == 0)


def fit_texts(
    docs: DataFrame, labels: DataFrame, text: str, stats: str, id_column: str = "doc_id", label: str = "quality", max_rows: int = MAX_TRAINING_ROWS
) -> DecisionList:
    """What ``fit`` learns from the statistics of all rows of ``docs``, counting no more of them than it takes.

    It takes rows by ascending MD5 of their id. So if there are many more labelled ids, the
    texts below a hash that about twice ``max_rows`` of these are below are counted first;
    if ``max_rows`` of these pass the base rules, no other row can be among those taken.
    Otherwise all are counted.
    """
    from rarebird.sources.staging import stage

    share = 2 * max_rows / max(1, _known(labels, id_column, label).count())
    rows = docs.select(id_column, text)
    if share < 1:
        below = rows.filter(F.md5(F.col(id_column).cast("string")) < F.lit(f"{int(share * 2**32):08x}"))
        measured = stage(with_statistics(below, text, stats).drop(text), "quality-statistics")
        found = _training_rows(measured, labels, stats, id_column, label, max_rows)
        if len(found) == max_rows:
            return _learned(found)
    measured = stage(with_statistics(rows, text, stats).drop(text), "quality-statistics")
    return fit(measured, labels, stats, id_column, label, max_rows)


def judge(measured: DataFrame, rules: DecisionList, stats: str = "stats") -> DataFrame:
    """All rows and columns, with base_failed and kept, which replace columns so named."""
    failed = base_failed(stats)
    return measured.withColumns({"base_failed": failed, "kept": ~failed & rules.kept(features(stats))})


def quality_verdicts(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row: the id, the statistics, base_failed and kept.

    Null and empty texts have no words and fail the base rules. Repeated rows and
    rows without id are judged like any other. The statistics are written once
    to the shared folder, learned from, and read again.
    """
    from rarebird.sources.staging import stage

    stats = free_name(docs, "stats")
    measured = stage(with_statistics(docs.select(id_column, text), text, stats).drop(text), "quality-statistics")
    judged = judge(measured, fit(measured, labels, stats, id_column), stats)
    return judged.select(id_column, f"{stats}.*", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows that the base rules and the learned list keep, unchanged."""
    stats, judged = free_name(docs, "stats"), free_name(docs, "judged")
    # Counting twice costs less than moving texts to their labels, or writing them with their statistics.
    rules = fit_texts(docs, labels, text, stats, id_column, max_rows=MAX_TRAINING_ROWS)
    verdict = with_statistics(docs, text, stats)
    return (
        verdict.withColumn(judged, ~base_failed(stats) & rules.kept(features(stats))).filter(judged).drop(stats, judged)
    )
