"""Quality rules: counted rule statistics per document, and an isolation forest over them.

The forest grows trees of random splits over the statistics of good labelled documents; a document that few splits
isolate (a short mean path) is anomalous. The threshold on the anomaly score is calibrated on labelled rows that the trees haven't seen. Its floor is the score that `keep_share` of the good ones don't exceed.
Where at least half of the bad ones beyond the floor lie beyond all good ones too, it moves up, to the middle between the last good one and the first bad one after it: it then rejects fewer bad ones than the floor
would, but no good one that is known.

Of the 2 * `max_labelled` labelled documents with the smallest hashes of their ids, at most `max_labelled` that pass the base rules are used for fitting and calibration, so what goes to the driver is bounded; the statistics
and the verdicts cover every row.

Edge cases: a null or empty text has 0 words and fails the base rules; documents with equal texts get equal
verdicts; rows that repeat an id come in the order of their counts; with fewer than `least_good` good labels the base rules alone decide; a table without rows gives one without rows. The input
may have any further columns: only the id and the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilink.llm import wordbytes as wb
from lexilink.llm.common import Scratch, arrow_rows, give_back, written

#: Texts are counted in batches of about so many bytes, or one text.
BATCH_BYTES = 1 << 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_chars", "n_lines", "n_upper", "n_digits", "n_bang", "n_distinct_words", "n_marked_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags each text has, without an array of numbers as long as the text."""
    out = np.zeros(len(offsets) - 1, np.int64)
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(filled):
        out[filled] = np.add.reduceat(flags, offsets[filled], dtype=np.int64)
    return out


def _owner(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def _salted(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return h ^ wb.mix(owner.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def count_statistics(column: pa.Array, shingle: int = 3) -> dict[str, np.ndarray]:
    """COUNTS and EXTRA for each text of a string array."""
    data, offsets = wb.text_bytes(column)
    n = len(offsets) - 1
    starts, ends, bounds = wb.word_spans(data, offsets)
    out = {"n_words": np.diff(bounds)}
    solid = ~wb.SPACE[data]
    head = (data & 0xC0) != 0x80
    out["word_chars"] = _per_text(solid & head, offsets)
    out["n_symbols"] = _per_text(_SYMBOL[data], offsets)
    out["n_chars"] = _per_text(head, offsets)
    out["n_upper"] = _per_text((data >= 65) & (data <= 90), offsets)
    out["n_digits"] = _per_text((data >= 48) & (data <= 57), offsets)
    out["n_bang"] = _per_text(data == 33, offsets)

    # Lines: a text's end and every \n end one; only lines with a word are compared.
    newline = data == 10
    out["n_lines"] = _per_text(newline, offsets) + 1
    cuts = np.flatnonzero(newline)
    line_starts = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data)) if len(line_starts) else line_starts
    owner = np.searchsorted(offsets, line_starts, "right") - 1
    closed = (line_ends > line_starts) & (data[np.maximum(line_ends - 1, 0)] == 10) if len(data) else np.zeros(0, bool)
    line_ends = line_ends - closed
    wordy = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    ls, le, owner = line_starts[wordy], line_ends[wordy], owner[wordy]
    keys = _salted(wb.spans_hash(data, ls, le, exact_case=True), owner)
    _, first = np.unique(keys, return_index=True)
    out["n_dup_lines"] = np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n)

    words = wb.spans_hash(data, starts, ends, exact_case=True)
    word_owner = _owner(bounds)
    keys = _salted(words, word_owner)
    distinct = np.unique(keys, return_index=True)[1]
    out["n_distinct_words"] = np.bincount(word_owner[distinct], minlength=n)
    marks = np.flatnonzero(_SYMBOL[data] | (data == 33))
    out["n_marked_words"] = np.bincount(word_owner[np.searchsorted(marks, ends) > np.searchsorted(marks, starts)], minlength=n)

    windows = wb.shingle_hash(words, shingle)
    inside = word_owner[: len(windows)] == word_owner[shingle - 1 :][: len(windows)]
    keys = _salted(windows, word_owner[: len(windows)])
    keys[~inside] = 0
    order = np.argsort(keys)
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    repeated = np.zeros(len(keys), bool)
    repeated[order] = same[1:] | same[:-1]
    repeated &= inside
    covered = np.zeros(len(words), bool)
    for k in range(shingle):
        covered[k : k + len(windows)] |= repeated
    out["n_repeat_words"] = np.bincount(word_owner[covered], minlength=n)
    return {k: np.asarray(v, np.int64) for k, v in out.items()}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the counts of every whole text."""
    names = [*COUNTS, *EXTRA]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(iterator):
        for batch in wb.batches(iterator, "text", BATCH_BYTES):
            counts = count_statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(counts[c]) for c in names]], [id_col, *names])
        give_back()

    plain = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in names))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios that don't depend on a text's length, one row per document."""
    c = {k: np.asarray(v, float) for k, v in counts.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack(
        [
            c["word_chars"] / words,
            c["n_symbols"] / chars,
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words,
            c["n_upper"] / chars,
            c["n_digits"] / chars,
            c["n_bang"] / words,
            c["n_marked_words"] / words,
            np.minimum(1.0, (words - c["n_distinct_words"]) / words / np.maximum(0.05, np.log10(words) / 5)),
        ]
    )


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


class IsolationForest:
    """Random-split trees in arrays; score() is 2 ** (-mean path / usual path)."""

    def __init__(self, trees: int = 100, sample: int = 256, seed: int = 7):
        self.trees, self.sample, self.seed = trees, sample, seed
        self.nodes: list[tuple[np.ndarray, ...]] = []

    @staticmethod
    def usual_path(n):
        n = np.maximum(np.asarray(n, float), 1.0)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))

    def fit(self, x: np.ndarray, weights: np.ndarray | None = None, margin: np.ndarray | None = None) -> IsolationForest:
        """weights: how often a feature is split, 0 for never; margin: how far splits reach beyond the rows' range."""
        rng = np.random.default_rng(self.seed)
        self.weights = np.ones(x.shape[1]) if weights is None else weights
        self.margin = 0.2 * (x.max(axis=0) - x.min(axis=0)) if margin is None else margin
        self.per_tree = min(self.sample, len(x))
        depth = int(np.ceil(np.log2(max(self.per_tree, 2)))) + 2
        self.nodes = [self._grow(x[rng.choice(len(x), self.per_tree, replace=False)], rng, depth) for _ in range(self.trees)]
        return self

    def _grow(self, x: np.ndarray, rng, depth: int):
        feature, cut, left, right, path = [], [], [], [], []

        def node(rows, d) -> int:
            at = len(feature)
            feature.append(-1), cut.append(0.0), left.append(at), right.append(at), path.append(0.0)
            # Splits reach beyond the sample's own range, so that values that no good document has fall off early.
            low, high = rows.min(axis=0), rows.max(axis=0)
            chance = self.weights * ((high > low) | (self.margin > 0))
            if d >= depth or len(rows) <= 1 or not chance.any():
                path[at] = d + float(self.usual_path(len(rows)))
                return at
            f = int(rng.choice(len(chance), p=chance / chance.sum()))
            c = rng.uniform(low[f] - self.margin[f], high[f] + self.margin[f])
            under = rows[:, f] < c
            if under.all() or not under.any():
                feature[at], cut[at] = f, c
                empty = len(feature)
                feature.append(-1), cut.append(0.0), left.append(empty), right.append(empty), path.append(float(d + 1))
                rest = node(rows, d + 1)
                left[at], right[at] = (rest, empty) if under.all() else (empty, rest)
                return at
            feature[at], cut[at] = f, c
            left[at] = node(rows[under], d + 1)
            right[at] = node(rows[~under], d + 1)
            return at

        node(x, 0)
        return tuple(np.array(a) for a in (feature, cut, left, right, path)) + (depth,)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, path, depth in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                f = feature[at]
                if (f < 0).all():
                    break
                under = x[rows, np.maximum(f, 0)] < cut[at]
                at = np.where(under, left[at], right[at])
            total += path[at]
        return 2.0 ** (-total / max(len(self.nodes), 1) / max(float(self.usual_path(self.per_tree)), 1e-9))


def separation(x: np.ndarray, y: np.ndarray, least: float = 0.3) -> np.ndarray:
    """How well each feature alone tells the rows of x from those of y: twice the distance of the AUC from 1/2, below `least` 0."""
    out = np.zeros(x.shape[1])
    for f in range(x.shape[1]):
        ordered = np.sort(x[:, f])
        auc = (np.searchsorted(ordered, y[:, f], "left") + np.searchsorted(ordered, y[:, f], "right")).mean() / 2 / len(x)
        out[f] = 2 * abs(auc - 0.5)
    return np.where(out >= least, out, 0.0) if (out >= least).any() else np.ones(x.shape[1])


def sampled_labels(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """(id, label) of the labelled documents with the smallest hashes of their ids, at most `most`."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("label")).withColumn("place", F.xxhash64(id_col))
    n = marks.count()
    if n > 2 * most:
        # A range of hashes with about twice what is asked for first: no partition sends more than its share to the driver.
        marks = marks.where(F.col("place") <= int(-(2.0**63) + 2.0**64 * 2 * most / n))
    return marks.orderBy("place", id_col).limit(most)


def fit(stats: DataFrame, chosen: DataFrame, id_col: str = "doc_id", max_labelled: int = 20_000, keep_share: float = 0.995, least_good: int = 20):
    """(forest, threshold) from at most max_labelled of the `chosen` labelled rows that pass the base rules; None with fewer than least_good good ones, which tell nothing of a distribution. Features are weighed by labels from least_good bad ones on; where labels tell no feature apart, all weigh the same."""
    names = [*COUNTS, *EXTRA]
    passed = stats.join(F.broadcast(chosen), id_col).where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    rows = passed.orderBy("place", id_col, *names).limit(max_labelled).select("label", *names).toPandas()
    good, bad = rows[rows.label == 1], rows[rows.label == 0]
    if len(good) < least_good:
        return None
    # Even rows grow the forest; the threshold comes from rows that it hasn't seen.
    x, y = features({k: good[k].to_numpy() for k in names}), features({k: bad[k].to_numpy() for k in names})
    both = np.concatenate([x, y])
    weights = separation(x[::2], y[::2]) if len(y) >= least_good else np.ones(x.shape[1])
    forest = IsolationForest().fit(x[::2], weights, 0.25 * (np.quantile(both, 0.99, axis=0) - np.quantile(both, 0.01, axis=0)))
    held, wrong = forest.score(x[1::2]), forest.score(y[1::2]) if len(y) else np.zeros(0)
    floor = np.quantile(held, keep_share)
    above = np.sort(wrong[wrong > floor])
    top = held.max()
    # Between the good rows and the bad ones that lie beyond them all, if any do.
    beyond = above[above > top]
    threshold = (top + beyond[0]) / 2 if len(beyond) >= 0.5 * max(len(above), 1) and len(beyond) else floor
    return forest, float(threshold)


def judge(stats: DataFrame, model, id_col: str = "doc_id") -> DataFrame:
    """Statistics with base_failed, score and kept."""
    names = [*COUNTS, *EXTRA]
    kind = stats.schema[id_col].dataType.simpleString()

    def run(iterator):
        for batch in iterator:
            table = {k: batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in names}
            failed = base_failed(table["n_words"], table["n_repeat_words"])
            score = model[0].score(features(table)) if model is not None and len(failed) else np.zeros(len(failed))
            kept = ~failed & (score <= model[1]) if model is not None else ~failed
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(id_col)), *[pa.array(table[k]) for k in COUNTS], pa.array(failed), pa.array(kept), pa.array(score)],
                [id_col, *COUNTS, "base_failed", "kept", "score"],
            )
        give_back()

    return stats.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000, least_good: int = 20) -> DataFrame:
    """Every document with its counts, base_failed, kept and anomaly score. The counts are written once and read for both the fit and the verdicts."""
    with arrow_rows(docs.sparkSession, 2000), Scratch(docs.sparkSession) as scratch:
        stats = written(statistics(docs, id_col, text_col), "quality-statistics")
        chosen = scratch.written(sampled_labels(labels, id_col, label_col, 2 * max_labelled), "quality-labels")
        return judge(stats, fit(stats, chosen, id_col, max_labelled, least_good=least_good), id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000, least_good: int = 20) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep; each row is judged where it is read.

    The fit comes before that and counts the texts of its labelled rows alone."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch, arrow_rows(spark, 2000):
        chosen = scratch.written(sampled_labels(labels, id_col, label_col, 2 * max_labelled), "quality-labels")
        known = docs.select(id_col, text_col).join(F.broadcast(chosen.select(id_col)), id_col, "left_semi")
        model = fit(scratch.written(statistics(known, id_col, text_col), "quality-statistics"), chosen, id_col, max_labelled, least_good=least_good)

    def run(iterator):
        for batch in wb.batches(iterator, text_col, BATCH_BYTES):
            counts = count_statistics(batch.column(batch.schema.get_field_index(text_col)))
            kept = ~base_failed(counts["n_words"], counts["n_repeat_words"])
            if model is not None:
                kept &= model[0].score(features(counts)) <= model[1]
            yield batch.filter(pa.array(kept))
        give_back()

    return docs.mapInArrow(run, docs.schema)
