"""Quality rules: a decision list learned from labelled documents.

Statistics of each text are counted in one Arrow pass. On the statistics of all labelled documents, sequential covering
grows one conjunction of thresholds at a time (the condition with the most FOIL gain next), prunes it on rows that it was
not grown on, keeps it if it is precise there, takes away the rows it covers and goes on. A step of it is one aggregate over
the stored statistics, to a few numbers per condition; thresholds are exact quantiles of all labelled rows. The list becomes
one ordered Spark `when` chain.

Cases: a null text has no words and fails the base rules. A ratio over nothing is 0. Labels that are null, or of unknown
documents, do not count; a document labelled twice counts twice. Without labels of both kinds the list is empty and every
document that passes the base rules is kept. Ties between conditions go to the first feature and the lowest threshold.
Repeated rows get equal results. Extra columns pass unchanged; one named like a statistic is replaced. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe.llm import linking, words

MIN_WORDS = 20
MAX_REPEATED = 30  # percent of words in repeated windows
WINDOW = 8
TASK_ROWS = 100_000  # labelled rows that one task counts
THRESHOLDS = 48  # candidate thresholds of a feature
MAX_CONDITIONS = 4
MAX_RULES = 12
MIN_PRECISION = 0.9  # of a rule, on the rows kept for pruning

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_digits", "n_marks"]
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), range(65, 91))
_DIGIT = np.isin(np.arange(256), range(48, 58))
_MARK = np.isin(np.arange(256), list(b"!?"))


def count_texts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The statistics of each text."""
    w = words.find_words(texts)
    n = len(texts)
    begins = w.offset[:-1]

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int64), begins) if n else np.zeros(0, dtype=np.int64)

    char = (w.buf & 0xC0) != 0x80
    out = {
        "n_words": w.counts,
        "word_chars": per_text(char & ~words.WHITE[w.buf]),
        "n_symbols": per_text(_SYMBOL[w.buf]),
        "n_repeat_words": _repeated_words(w),
        "n_upper": per_text(_UPPER[w.buf]),
        "n_digits": per_text(_DIGIT[w.buf]),
        "n_marks": per_text(_MARK[w.buf]),
    }
    lines, repeated = [], []
    for text in texts:
        filled = [x for x in text.split(b"\n") if x.strip()]
        lines.append(len(filled))
        repeated.append(len(filled) - len(set(filled)))
    out["n_lines"] = np.array(lines, dtype=np.int64)
    out["n_dup_lines"] = np.array(repeated, dtype=np.int64)
    return out


def _repeated_words(w: words.Words) -> np.ndarray:
    """Words inside windows of eight words that the text holds twice or more."""
    n = len(w.doc)
    n_texts = len(w.first) - 1
    if n < WINDOW:
        return np.zeros(n_texts, dtype=np.int64)
    hashes = words.word_hashes(w)
    whole = np.flatnonzero(np.arange(n) + WINDOW <= w.first[1:][w.doc])
    key = np.zeros(len(whole), dtype=np.uint64)
    for j in range(WINDOW):
        key += hashes[whole + j] * words._PLACES[j]
    key = words.mix(key + w.doc[whole].astype(np.uint64) * words._PLACES[WINDOW])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, whole[twice], 1)
    np.add.at(change, whole[twice] + WINDOW, -1)
    covered = np.cumsum(change[:n]) > 0
    return np.bincount(w.doc[covered], minlength=n_texts)


def statistics(docs: DataFrame, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """The rows with the statistics of their text, as long columns."""
    names = COUNTS + MORE
    kept = [c for c in docs.columns if c not in names and not (drop_text and c == text_col)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = words.as_bytes(batch.column(text_col))
            for start, stop in words.pieces(map(len, texts)):
                found = count_texts(texts[start:stop])
                part = batch.slice(start, stop - start).select(kept)
                columns = [*part.columns, *(pa.array(found[c], type=pa.int64()) for c in names)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    return docs.mapInArrow(run, schema)


def features() -> dict[str, Column]:
    """Features of the learner, from the statistics."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "n_words"),
        "repeated_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "upper": share("n_upper", "word_chars"),
        "digits": share("n_digits", "word_chars"),
        "marks": share("n_marks", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # at or above the threshold, else at or below
    threshold: float

    def covers(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.feature] >= self.threshold if self.above else values[self.feature] <= self.threshold

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, values: dict[str, np.ndarray]) -> np.ndarray:
    hit = np.ones(len(next(iter(values.values()))), dtype=bool)
    for condition in rule:
        hit &= condition.covers(values)
    return hit


# Rows left by part (0: kept for pruning, 1: grown on) and kind (0: good, 1: bad): all of them, then those that each
# candidate covers too.
Counts = np.ndarray
# Counts of the rows that no rule so far covers and all chosen conditions do; conditions are numbers of candidates.
Count = Callable[[list[list[int]], list[int]], Counts]


def _ranks(n: int) -> np.ndarray:
    return np.unique(np.rint(np.linspace(0, 1, THRESHOLDS) * (n - 1)).astype(np.int64))


def _candidates(thresholds: dict[str, np.ndarray]) -> list[Condition]:
    return [Condition(name, above, float(t)) for name, of in thresholds.items() for t in of for above in (True, False)]


def _counts(
    candidates: list[Condition], found: list[list[int]], chosen: list[int], values: dict[str, np.ndarray], bad: np.ndarray, grow_on: np.ndarray
) -> Counts:
    left = covers(tuple(candidates[c] for c in chosen), values)
    for rule in found:
        left &= ~covers(tuple(candidates[c] for c in rule), values)
    group = (2 * grow_on[left] + bad[left]).astype(np.int64)
    out = [np.bincount(group, minlength=4)[:, None]]
    for name in dict.fromkeys(c.feature for c in candidates):
        steps = np.array([c.threshold for c in candidates if c.feature == name and c.above])
        size = len(steps) + 1

        def reached(side: str) -> np.ndarray:  # rows by the number of thresholds that they reach, added up
            at = np.searchsorted(steps, values[name][left], side=side)
            return np.cumsum(np.bincount(group * size + at, minlength=4 * size).reshape(4, size), axis=1)

        at_least, at_most = reached("right"), reached("left")
        both = np.stack([at_least[:, -1:] - at_least[:, :-1], at_most[:, :-1]], axis=2)
        out.append(both.reshape(4, -1))
    return np.concatenate(out, axis=1).reshape(2, 2, -1)


def learn(values: dict[str, np.ndarray], bad: np.ndarray, grow_on: np.ndarray) -> list[Rule]:
    """Rules, in order, that pick the bad rows; grown on one part of the rows and pruned on the other."""
    if bad.all() or not bad.any():
        return []
    ordered = {name: np.sort(np.concatenate([v, v[bad]])) for name, v in values.items()}
    candidates = _candidates({name: np.unique(v[_ranks(len(v))]) for name, v in ordered.items()})
    return _covering(candidates, lambda found, chosen: _counts(candidates, found, chosen, values, bad, grow_on))


def _covering(candidates: list[Condition], count: Count) -> list[Rule]:
    found: list[list[int]] = []
    while len(found) < MAX_RULES:
        chosen: list[int] = []
        seen = [count(found, [])]
        if not seen[0][1, 1, 0]:
            break
        while len(chosen) < MAX_CONDITIONS and seen[-1][1, 0, 0]:
            (n0, *n), (p0, *p) = seen[-1][1]
            best = _best(np.array(p), np.array(n), p0, n0)
            if best is None:
                break
            chosen.append(best)
            seen.append(count(found, chosen))
        left = [s[:, :, 0] for s in seen]
        size = _pruned(left)
        hit = left[size]
        if not size or not hit[:, 1].sum() or hit[0, 1] < MIN_PRECISION * max(hit[0].sum(), 1):
            break
        found.append(chosen[:size])
    return [tuple(candidates[c] for c in rule) for rule in found]


def _best(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> int | None:
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = p * (np.log2(p / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0)))
    gain = np.where(p > 0, gain, -np.inf)
    best = int(np.argmax(gain))
    return best if gain[best] > 1e-9 else None


def _pruned(left: list[np.ndarray]) -> int:
    """Size of the shortest beginning of the rule that is worth most on rows it was not grown on; `left` by size."""
    best, worth = len(left) - 1, -2.0
    if not left[0][0, 1]:
        return best
    for size in range(1, len(left)):
        n, p = left[size][0]
        now = (p - n) / max(p + n, 1)
        if now > worth + 1e-12:
            best, worth = size, now
    return best


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of all labelled documents that pass the base rules, with `_bad` and `_grow`. No text is joined."""
    known = labels.where("doc_id is not null and quality is not null").select(
        F.col("doc_id").alias("_labelled"), F.col("quality").cast("int").alias("_quality")
    )
    stats = statistics(docs.select("doc_id", "text"), drop_text=True).where(~base_failed())
    return stats.join(known, F.col("doc_id") == F.col("_labelled")).select(
        (F.col("_quality") == 0).alias("_bad"),
        (F.pmod(F.xxhash64("_labelled", F.lit(7)), F.lit(3)) > 0).alias("_grow"),
        *[c.alias(name) for name, c in features().items()],
    )


def _thresholds(table: DataFrame, n: int) -> dict[str, np.ndarray]:
    """Values at the ranks of each feature, where a bad row counts twice; `n` is the sum of that.

    Equal values are counted, the counts range partitioned by feature and value and each part summed by itself; a lift per
    part and feature connects them.
    """
    names = list(features())
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("v")) for i, c in enumerate(names)]))
    counts = table.select(pairs.alias("x"), F.when(F.col("_bad"), 2).otherwise(1).alias("w"))
    counts = counts.groupBy(F.col("x.f").alias("f"), F.col("x.v").alias("v")).agg(F.sum("w").alias("w"))
    parts = linking.stored(counts.repartitionByRange("f", "v").withColumn("part", F.spark_partition_id()), "values")
    before = Window.partitionBy("f").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lifts = parts.groupBy("part", "f").agg(F.sum("w").alias("all")).withColumn("before", F.coalesce(F.sum("all").over(before), F.lit(0)))
    upto = F.col("before") + F.sum("w").over(Window.partitionBy("part", "f").orderBy("v"))
    placed = parts.join(lifts.drop("all"), ["part", "f"]).select("f", "v", upto.alias("upto"), (upto - F.col("w")).alias("under"))
    ranks = F.array(*[F.lit(int(r)) for r in _ranks(n)])
    held = placed.where(F.exists(ranks, lambda r: (r >= F.col("under")) & (r < F.col("upto"))))
    got = held.select("f", "v").collect()  # THRESHOLDS rows of a feature at most
    linking.discard(parts)
    return {name: np.array(sorted(v for f, v in got if f == i)) for i, name in enumerate(names)}


def learn_from(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """The decision list, learned from all labelled documents; the driver gets counts of conditions only."""
    found = linking.stored(labelled(docs, labels), "labelled")
    rows, bad = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("_bad").cast("long")), F.lit(0))).first()
    learned: list[Rule] = []
    if 0 < bad < rows:
        # as many parts as the rows need, or every step has a task per file
        table = linking.stored(found.repartition(-(-rows // TASK_ROWS)), "labelled")
        candidates = _candidates(_thresholds(table, rows + bad))
        learned = _covering(candidates, lambda rules, chosen: _counted(table, candidates, rules, chosen))
        linking.discard(table)
    linking.discard(found)
    return learned


def _counted(table: DataFrame, candidates: list[Condition], found: list[list[int]], chosen: list[int]) -> Counts:
    names = list(features())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, 1 + len(candidates)), dtype=np.int64)
        for batch in batches:
            values = {name: batch.column(name).to_numpy() for name in names}
            flags = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_bad", "_grow")]
            total += _counts(candidates, found, chosen, values, *flags)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "n"])

    out = np.zeros((2, 2, 1 + len(candidates)), dtype=np.int64)
    for at, n in table.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        out.ravel()[at] = n
    return out


def fired(rules: list[Rule]) -> Column:
    """Number of the first rule that covers the row, from 1; 0 without one."""
    chain = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for condition in rule[1:]:
            test &= condition.column()
        chain = F.when(test, F.lit(k)) if chain is None else chain.when(test, F.lit(k))
    return F.lit(0) if chain is None else chain.otherwise(F.lit(0))


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows with their statistics, `base_failed`, the rule that fired and `kept`."""
    return (
        statistics(docs)
        .withColumn("base_failed", base_failed())
        .withColumn("rule", fired(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )


def filtered(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that are kept, with their own columns only."""
    flagged = docs.select(F.struct("*").alias("_row"), F.col("text"))
    return judged(flagged, rules).where("kept").select("_row.*")
