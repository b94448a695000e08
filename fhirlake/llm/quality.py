"""Document quality from heuristics alone: a weak-label model teaches a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fhirlake.llm.sampling import likely
from fhirlake.llm.spans import RangeHash, U, groups, releasing, text_bytes

# Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he his from are this at or have an they which "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat "
    "le la les et des du un une que est dans qui pour par sur pas au plus ne se ce il sont avec "
    "el los las y en se del por con para su al lo como pero sus esta entre cuando muy sin sobre"
).split()
SYMBOLS = b"#$%&*!|<>{}[]~^=+\\_@`"

#: The scorer is fitted on so many documents; statistics of the labellers cover all.
TRAIN_ROWS = 5_000
#: Features take some hundred bytes for each byte of text, in every worker of an executor.
RUN_BYTES = 1 << 17
WORD_FEATURES, SHAPE_FEATURES = 1 << 15, 1 << 12
GOOD, BAD, ABSTAIN = 1, 0, 2

_CLASS = np.full(256, 7, np.int64)  # bytes of longer characters
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[list(b".,;:?'\"()-")] = 4
_CLASS[list(SYMBOLS)] = 5
_CLASS[list(b"/")] = 6


class Text:
    """Bytes of many texts, their words and the sums over each text."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray) -> None:
        self.raw, self.starts, self.n = raw, starts, len(starts) - 1
        self.kind = _CLASS[raw]
        visible = self.kind != 0
        begins = visible.copy()
        begins[1:] &= ~visible[:-1]
        inner = starts[:-1][np.diff(starts) > 0]
        begins[inner] = visible[inner]
        ends = visible.copy()
        ends[:-1] &= ~visible[1:]
        last = starts[1:][np.diff(starts) > 0] - 1
        ends[last] = visible[last]
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.owner = np.searchsorted(starts, self.begin, "right") - 1
        self.words = np.bincount(self.owner, minlength=self.n)
        lower = np.where(self.kind == 2, raw + 32, raw).astype(np.uint8)
        self.hashes = RangeHash(lower)(self.begin, self.end)

    def repeated(self) -> np.ndarray:
        """Words that equal the word before them in the same text."""
        found = np.zeros(len(self.hashes), bool)
        found[1:] = (self.hashes[1:] == self.hashes[:-1]) & (self.owner[1:] == self.owner[:-1])
        return found

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        sums = np.append(0, np.cumsum(flags))
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def per_words(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per word over each text."""
        return np.bincount(self.owner, weights=flags, minlength=self.n)


def _stop_hashes() -> np.ndarray:
    raw = np.frombuffer(" ".join(STOP_WORDS).encode(), np.uint8)
    return np.unique(Text(raw, np.array([0, len(raw)])).hashes)


def vote(value: np.ndarray, good: np.ndarray, bad: np.ndarray, enough: np.ndarray) -> np.ndarray:
    votes = np.full(len(value), ABSTAIN, np.int64)
    votes[enough & good] = GOOD
    votes[enough & bad] = BAD
    return votes


def label(text: Text, stop: np.ndarray) -> np.ndarray:
    """Votes of the heuristic labellers, one row per text: good, bad or no opinion."""
    size, words = np.maximum(np.diff(text.starts), 1), np.maximum(text.words, 1)
    some, many = text.words >= 5, text.words >= 40

    symbols = text.per_text(text.kind == 5) / size
    upper, lower = text.per_text(text.kind == 2), text.per_text(text.kind == 1)
    capital = upper / np.maximum(upper + lower, 1)
    at = np.minimum(np.searchsorted(stop, text.hashes), len(stop) - 1)
    common = text.per_words(stop[at] == text.hashes) / words
    length = text.per_words(text.end - text.begin) / words
    pairs = np.unique(np.stack([text.owner.astype(U), text.hashes]), axis=1)[0] if len(text.owner) else text.owner
    distinct = np.maximum(np.bincount(pairs.astype(np.int64), minlength=text.n), 1)
    rich = np.log(distinct) / np.log(np.maximum(words, 2))
    final = text.raw[text.end - 1] if len(text.end) else text.end
    before = text.kind[np.maximum(text.end - 2, 0)] if len(text.end) else text.end
    stops = text.per_words(np.isin(final, list(b".?!")) & np.isin(before, [1, 2, 7])) / words
    sums = np.append(0, np.cumsum(np.isin(text.kind, [1, 2, 3, 7])))
    marks = text.per_words(sums[text.end] == sums[text.begin]) / words
    again = text.per_words(text.repeated()) / words
    tailed = text.per_words((text.end - text.begin > 1) & (text.kind[text.end - 1] == 5)) / words

    return np.stack(
        [
            vote(symbols, symbols < 0.01, symbols > 0.03, some),
            vote(capital, capital < 0.15, capital > 0.4, upper + lower >= 20),
            vote(common, common > 0.06, common < 0.02, many),
            vote(length, (length > 2) & (length < 8), (length < 1.5) | (length > 12), some),
            vote(rich, rich > 0.75, rich < 0.6, text.words >= 100),
            vote(stops, (stops > 0.01) & (stops < 0.4), (stops < 0.003) | (stops > 0.6), many),
            vote(marks, marks < 0.02, marks > 0.1, some),
            vote(again, again < 0.05, again > 0.2, some),
            vote(tailed, tailed < 0.02, tailed > 0.2, some),
        ],
        axis=1,
    )


LABELLERS = 9


class Labellers:
    """Per labeller how often it calls good texts good and bad texts bad, and the share of good texts."""

    def __init__(self, on_good: np.ndarray, on_bad: np.ndarray, share: float) -> None:
        self.on_good, self.on_bad, self.share = on_good, on_bad, share

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of being good, for each row of votes; a labeller without opinion tells nothing."""
        good = np.log(self.on_good / (1 - self.on_bad))
        bad = np.log((1 - self.on_good) / self.on_bad)
        odds = np.where(votes == GOOD, good, np.where(votes == BAD, bad, 0.0)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds + np.log(self.share / (1 - self.share)), -500, 500)))


def estimate(votes: np.ndarray, weights: np.ndarray, rounds: int = 100) -> Labellers:
    """Accuracies of overlapping labellers on good and on bad texts, by expectation-maximisation.

    `votes` has a row per pattern of votes and `weights` how many texts have it. The start
    values say which class is the good one: labellers are right about it. A labeller may then turn out wrong on up to half
    of the good texts, and blind to all but a twentieth of the bad ones.
    """
    model = Labellers(np.full(votes.shape[1], 0.995), np.full(votes.shape[1], 0.5), 0.8)
    for _ in range(rounds):
        p = model.posterior(votes)
        good, bad = (p * weights)[:, None], ((1 - p) * weights)[:, None]
        voted = votes != ABSTAIN
        # a few votes are added, so that a labeller seen rarely decides little
        on_good = (9.5 + (good * (votes == GOOD)).sum(0)) / (10 + (good * voted).sum(0))
        on_bad = (5 + (bad * (votes == BAD)).sum(0)) / (10 + (bad * voted).sum(0))
        share = float(np.clip(good.sum() / weights.sum(), 0.02, 0.98))
        model = Labellers(np.clip(on_good, 0.5, 0.999), np.clip(on_bad, 0.05, 0.99), share)
    return model


def features(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features: (text, feature, value). Words, and runs of four character classes; shares of each kind."""
    word = (text.hashes % U(WORD_FEATURES)).astype(np.int64)
    word[text.repeated()] = 0  # one feature for all words said again
    k = text.kind
    shape = np.zeros(len(k), np.int64)
    for back in range(4):
        shape[back:] += k[: len(k) - back] << (3 * back)
    inside = np.arange(len(k)) - np.repeat(text.starts[:-1], np.diff(text.starts)) >= 3
    owner = np.repeat(np.arange(text.n), np.diff(text.starts))
    words, shapes = np.maximum(text.words, 1), np.maximum(np.bincount(owner[inside], minlength=text.n), 1)
    return (
        np.concatenate([text.owner, owner[inside]]),
        np.concatenate([word, WORD_FEATURES + shape[inside]]),
        np.concatenate([1 / words[text.owner], 1 / shapes[owner[inside]]]),
    )


def sparse(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features by (text, feature). Square roots of shares, so that all texts have about the same length."""
    row, column, value = features(text)
    cell, inverse = np.unique(row * (WORD_FEATURES + SHAPE_FEATURES) + column, return_inverse=True)
    value = np.sqrt(np.bincount(inverse, weights=value)).astype(np.float32)
    row, column = np.divmod(cell, WORD_FEATURES + SHAPE_FEATURES)
    return row.astype(np.int32), column.astype(np.int32), value


def fit(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Weights and bias of a logistic model for soft targets, by accelerated gradient steps."""
    n, size = WORD_FEATURES + SHAPE_FEATURES, len(target)
    first = np.cumsum([0, *(r[3] for r in runs)])
    row = np.concatenate([r[0] + f for r, f in zip(runs, first)])
    column, value = (np.concatenate([r[i] for r in runs]) for i in (1, 2))
    # both classes weigh the same, however rare one is, unless one is all but absent
    good = target.sum()
    share = np.ones(size)
    if min(good, size - good) >= 5:
        share = size / 2 * (target / good + (1 - target) / (size - good))
    weights, ahead = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, rounds + 1):
        score = np.bincount(row, weights=value * ahead[column], minlength=size) + ahead[n]
        error = share * (1 / (1 + np.exp(-score)) - target)
        slope = np.append(np.bincount(column, weights=value * error[row], minlength=n), error.sum()) / size
        slope[:n] += 1e-5 * ahead[:n]
        moved = ahead - 2.0 * slope
        ahead = moved + (step - 1) / (step + 2) * (moved - weights)
        weights = moved
    if min(good, size - good) >= 5:
        weights[n] += np.log(good / (size - good))  # back to the shares the classes have
    return weights


def scores(text: Text, weights: np.ndarray) -> np.ndarray:
    row, column, value = sparse(text)
    score = np.bincount(row, weights=value * weights[column], minlength=text.n) + weights[-1]
    return np.where(text.words > 0, 1 / (1 + np.exp(-score)), 0.0)


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Text]]:
    """Texts (column 1) in runs of bounded size, with the rows they come from."""
    for batch in batches:
        raw, starts = text_bytes(batch.column(1))
        for first, after in groups(starts, RUN_BYTES):
            own = starts[first : after + 1]
            yield batch.slice(first, after - first), Text(raw[own[0] : own[-1]], own - own[0])


class Model:
    """The labellers' accuracies and the scorer's weights."""

    def __init__(self, labellers: Labellers, weights: np.ndarray) -> None:
        self.labellers, self.weights = labellers, weights


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Fits the weak-label model on the votes about all texts, and the scorer on `rows` of them.

    Vote patterns are counted over all documents (there are at most 3^9 of them). The sample for the scorer is drawn by
    hash of key and text and bounded by `rows`; its targets are the posterior labels.
    """
    spark: SparkSession = docs.sparkSession
    body = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = _stop_hashes()
        found = np.zeros(3**LABELLERS, np.int64)
        for _, run in texts(batches):
            codes = label(run, stop)[run.words > 0] @ 3 ** np.arange(LABELLERS)
            found += np.bincount(codes, minlength=len(found))
        code = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(found[code])], names=["code", "n"])

    patterns = body.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code")
    seen = patterns.collect()  # at most 3^9 rows
    size = WORD_FEATURES + SHAPE_FEATURES + 1
    if not seen:
        return Model(Labellers(np.full(LABELLERS, 0.95), np.full(LABELLERS, 0.5), 0.8), np.zeros(size))
    votes = np.array([r["code"] for r in seen])[:, None] // 3 ** np.arange(LABELLERS) % 3
    labellers = estimate(votes, np.array([r["n"] for r in seen], np.float64))

    @releasing
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = _stop_hashes()
        for batch, run in texts(batches):
            target = labellers.posterior(label(run, stop))
            row, column, value = sparse(run)
            cuts = pa.array(np.searchsorted(row, np.arange(run.n + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (column, value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(target), *lists], ["draw", "target", "columns", "values"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, targets = [], []
        for batch in batches:
            targets.append(batch.column("target").to_numpy())
            columns, values = batch.column("columns"), batch.column("values")
            sizes = pa.compute.list_value_length(columns).to_numpy()
            row = np.repeat(np.arange(batch.num_rows, dtype=np.int32), sizes)
            found.append((row, columns.flatten().to_numpy(), values.flatten().to_numpy(), batch.num_rows))
        weights = fit(found, np.concatenate(targets))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    # features leave the tasks, not texts; a text has at most as many as the scorer has weights
    total = sum(r["n"] for r in seen)
    draw = F.xxhash64(F.lit(7), "key", "text")
    some = body.filter("text rlike '\\\\S'").select(draw.alias("draw"), "text")
    some = some.filter(likely("draw", rows, total))
    described = some.mapInArrow(describe, "draw long, target double, columns array<int>, values array<float>")
    sample = described.orderBy("draw", "columns").limit(rows).select("target", "columns", "values")
    (row,) = sample.coalesce(1).mapInArrow(learn, "weights binary").limit(1).collect()
    return Model(labellers, np.frombuffer(row["weights"]))


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row of `docs`: doc_id, score (probability that the text is good) and keep (score of `threshold` or more).

    A null or empty text, or one without words, has score 0. Repeated rows and null keys get a row each.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    weights = model.weights

    @releasing
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, run in texts(batches):
            found = scores(run, weights)
            kept = pa.array(found >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), kept], names=["doc_id", "score", "keep"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"doc_id {kind}, score double, keep boolean")


def keep_good(docs: DataFrame, *, text: str = "text", **settings) -> DataFrame:
    """`docs` without the rows whose text the scorer, trained on `docs`, rejects.

    Null and empty texts and texts without words are rejected. Each row is judged by its text alone, so repeated rows stay or
    go together and keys may be null. Other columns are unchanged. An empty table gives no rows.
    """
    weights = train(docs, text=text, **settings).weights

    @F.arrow_udf("boolean")
    @releasing
    def good(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            pair = pa.RecordBatch.from_arrays([pa.nulls(len(column)), column], names=["none", "text"])
            kept = [scores(run, weights) >= 0.5 for _, run in texts([pair])]
            yield pa.array(np.concatenate(kept) if kept else np.empty(0, bool))

    # only the texts go to Python, the other columns stay where they are
    return docs.filter(good(F.coalesce(F.col(text), F.lit(""))))
