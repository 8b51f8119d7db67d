"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblio_spark.llm.bytescan import chunks, free_prefix
from biblio_spark.llm.decontaminate import word_hashes
from biblio_spark.storage import materialize

#: Labelled rows that a fit uses at most, chosen by a hash of their id.
FIT_ROWS = 20_000
#: Score from which a document counts as good.
THRESHOLD = 0.3
TREES, DEPTH, LASSO, SEED = 24, 3, 0.001, 7

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "longest_word", "upper", "digit", "symbol", "bar", "bang", "stop", "line",
    "space", "wide", "repeat_next", "repeat_share",
)


def _share(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]) / size


def _bytes(*characters: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for c in "".join(characters).encode():
        table[c] = True
    return table


_TABLES = {
    "upper": _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digit": _bytes("0123456789"),
    "symbol": _bytes("#$%&*@^~<>=+\\{}[]_/"),
    "bar": _bytes("|"),
    "bang": _bytes("!?"),
    "stop": _bytes(".,;:"),
    "line": _bytes("\n"),
    "space": _bytes(" \t\r"),
}
_WHITE = _bytes(" \t\n\r\x0b\x0c")


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of what white space parts, and the number before each text."""
    mask = ~_WHITE[data]
    begin, finish = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1]
    finish[:-1] &= ~mask[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begin[edges] = mask[edges]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    finish[lasts] = mask[lasts]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets)


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """STATISTICS of consecutive texts. Shares are of bytes or of words; an empty text has zeros."""
    n = np.diff(offsets).astype(float)
    size = np.maximum(n, 1)
    out = {name: _share(data, offsets, table, size) for name, table in _TABLES.items()}
    wide = np.zeros(256, dtype=bool)
    wide[0x80:] = True
    out["wide"] = _share(data, offsets, wide, size)
    starts, ends, before = _words(data, offsets)
    words = np.diff(before)
    many = np.maximum(words, 1)
    out["log_bytes"], out["log_words"] = np.log1p(n), np.log1p(words)
    lengths = ends - starts
    total = np.concatenate([[0], np.cumsum(lengths)])
    out["mean_word"] = (total[before[1:]] - total[before[:-1]]) / many
    longest = np.zeros(len(words))
    full = words > 0
    if full.any():
        longest[full] = np.maximum.reduceat(lengths, before[:-1][full])
    out["longest_word"] = np.log1p(longest)
    out["repeat_next"], out["repeat_share"] = _repeats(data, starts, ends, before, many)
    return out


def _repeats(data, starts, ends, before, many) -> tuple[np.ndarray, np.ndarray]:
    """Shares of words that equal the word before them, and of words that stood earlier in the text."""
    if not len(starts):
        return np.zeros(len(many)), np.zeros(len(many))
    hashed = word_hashes(data, starts, ends, ~_WHITE)
    text = np.repeat(np.arange(len(many)), np.diff(before))
    same = (hashed[1:] == hashed[:-1]) & (text[1:] == text[:-1])
    next_count = np.bincount(text[1:][same], minlength=len(many))
    order = np.lexsort((hashed, text))
    again = (hashed[order][1:] == hashed[order][:-1]) & (text[order][1:] == text[order][:-1])
    again_count = np.bincount(text[order][1:][again], minlength=len(many))
    return next_count / many, again_count / many


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and STATISTICS of every row, over whole texts; null is empty."""
    source = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch, "text"):
                found = text_statistics(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, end - first), *(pa.array(found[s].astype(float)) for s in STATISTICS)],
                    names=["id", *STATISTICS],
                )

    id_type = source.schema["id"].dataType.simpleString()
    rows = source.mapInArrow(scan, f"id {id_type}, " + ", ".join(f"{s} double" for s in STATISTICS))
    return rows.withColumnRenamed("id", id_column)


#: One condition: statistic, True for "<=" or False for ">", limit.
Condition = tuple[str, bool, float]


@dataclass(frozen=True)
class RuleModel:
    """score = sigmoid(intercept + sum of the weights of rules that hold)."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self, prefix: str = "") -> Column:
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            total = total + F.when(rule_column(conditions, prefix), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def rule_column(conditions: tuple[Condition, ...], prefix: str = "") -> Column:
    out = F.lit(True)
    for name, below, limit in conditions:
        value = F.col(prefix + name)
        out = out & ((value <= limit) if below else (value > limit))
    return out


_LINE = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def tree_rules(debug: str) -> list[tuple[Condition, ...]]:
    """The conjunctions on the paths to all nodes below the root, from Spark's description of a tree."""
    path: list[tuple[int, Condition]] = []
    rules = []
    for line in debug.splitlines():
        if m := _LINE.match(line):
            depth = len(m[1])
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, (STATISTICS[int(m[3])], m[4] == "<=", float(m[5]))))
            rules.append(tuple(c for _, c in path))
    return rules


def fit_rules(labelled: DataFrame, label: str = "label") -> RuleModel:
    """A rule ensemble from STATISTICS and a 0/1 ``label``: paths of a small forest become rules, and a logistic
    regression with a lasso penalty weighs them; rules without weight go. One class alone gives its share as a
    constant score, no rows give 0.5."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    n, good = labelled.agg(F.count("*"), F.coalesce(F.sum(label), F.lit(0))).first()
    rate = (good + 0.5) / (n + 1)
    constant = RuleModel(float(np.log(rate / (1 - rate))), ())
    if not 0 < good < n:
        return constant
    data = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(labelled).select("features", label, *STATISTICS)
    forest = RandomForestClassifier(
        labelCol=label, numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=SEED, minInstancesPerNode=5, featureSubsetStrategy="onethird"
    ).fit(data)
    rules = list(dict.fromkeys(r for tree in forest.trees for r in tree_rules(tree.toDebugString)))
    if not rules:
        return constant
    held = data.select(F.col(label), F.array(*(rule_column(r).cast("double") for r in rules)).alias("held"))
    from pyspark.ml.functions import array_to_vector

    held = held.select(label, array_to_vector("held").alias("rules"))
    fitted = LogisticRegression(labelCol=label, featuresCol="rules", elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(held)
    weights = fitted.coefficients.toArray()
    return RuleModel(float(fitted.intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def held_out(id_column: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 0 modulo 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_labels(labels: DataFrame, id_column: str = "doc_id", rows: int = FIT_ROWS) -> DataFrame:
    """(id, label) of at most ``rows`` labelled documents that are not held out, those with the least hashes of their ids. A
    label that is null or not 0 or 1 is no label; of repeated labels the mean decides."""
    return (
        labels.where(F.col("quality").isin(0, 1) & ~held_out(id_column) & F.col(id_column).isNotNull())
        .groupBy(id_column)
        .agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
        .orderBy(F.xxhash64(id_column), id_column)
        .limit(rows)
    )


def fit_sample(found: DataFrame, id_column: str = "doc_id", rows: int = FIT_ROWS) -> RuleModel:
    """The model from statistics with labels, in a fixed order so that a refit gives the same rules."""
    used = found.orderBy(F.xxhash64(id_column), id_column, *STATISTICS).limit(rows)
    return fit_rules(materialize(used.coalesce(1), "fit"))


def score_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    Null texts are empty, repeated rows get equal scores, texts of any length are scored whole, other columns are left aside, an
    empty table gives an empty result; a score of exactly THRESHOLD is predicted 1. Rows with a null id are not held out.

    Statistics of all whole texts are written once (some 130 bytes a document). The fit uses at most ``rows`` labelled
    documents that are not held out; this list, bounded by ``rows``, is the only broadcast. Scores are then plain
    column expressions over the statistics. Empty texts are scored like others; without labels all scores are 0.5.
    """
    found = materialize(statistics(docs, id_column, text_column), "statistics")
    model = fit_sample(found.join(F.broadcast(fit_labels(labels, id_column, rows)), id_column), id_column, rows)
    scored = found.select(id_column, held_out(id_column).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` with a score of THRESHOLD or more, all columns as they are. Only labelled texts of the fit are read
    twice; no text is shuffled."""
    marks = F.broadcast(fit_labels(labels, id_column, rows))
    sample = docs.select(id_column, text_column).join(marks, id_column)
    model = fit_sample(statistics(sample, id_column, text_column).join(marks, id_column), id_column, rows)
    names, extra = docs.columns, free_prefix(*docs.columns) + "statistics"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_column)
        for batch in batches:
            renamed = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            for first, end, data, offsets in chunks(renamed, "text"):
                found = text_statistics(data, offsets)
                values = pa.StructArray.from_arrays([pa.array(found[s].astype(float)) for s in STATISTICS], names=list(STATISTICS))
                yield pa.RecordBatch.from_arrays([*(c.slice(first, end - first) for c in batch.columns), values], names=[*names, extra])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    kinds = ", ".join(f"{s}: double" for s in STATISTICS)
    scored = docs.mapInArrow(add, f"{fields}, {extra} struct<{kinds}>")
    return scored.where(model.score(f"{extra}.") >= THRESHOLD).select(*(F.col(f"`{n}`") for n in names))
