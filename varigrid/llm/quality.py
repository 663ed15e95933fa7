"""Document quality from a linear-chain conditional random field over lines (operator 2).

Every line with something other than blanks is labelled good or bad. Its features are its own shape and that of
the lines before and after it; the chain has transition weights. Document labels teach the lines: lines of
documents labelled 1 are good; lines of the others begin as bad, and in a few rounds those that the model
takes for good become good, though one bad line at least stays. A document's quality is the mean of its
lines' forward-backward marginals, weighted by line length, and a logistic curve maps it to a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid.llm.common import bounded, dropped, fold, steps, table, without, written
from varigrid.llm.shingles import GOLDEN, LONG, Rolling, mixed

#: Bounds of the training sample: labelled rows, and the lines that reach the driver. Rows are taken whole, in the order of their
#: hash, as long as their lines fit; the first is always taken.
TRAINING_ROWS, TRAINING_LINES = 6000, 300_000
#: A training row of more than this part of the lines does not teach.
LONG_ROW = 20
ROUNDS, STEPS, RATE, RIDGE = 3, 120, 0.1, 1e-3
KEEP = 0.7
#: Classes of characters.
SYMBOL, LOWER, UPPER, DIGIT, SPACE, END, PUNCTUATION, LOUD = range(8)
_CLASS: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point."""
    if not _CLASS:
        every = list(map(chr, range(0x110000)))
        of = np.zeros(0x110000, np.uint8)
        for kind, test in ((LOWER, str.isalpha), (UPPER, str.isupper), (DIGIT, str.isdigit), (SPACE, str.isspace)):
            of[np.frombuffer(bytes(map(test, every)), bool)] = kind
        of[[ord(c) for c in ".,;:'\"()-?"]] = PUNCTUATION
        of[ord("!")] = LOUD
        of[10] = END
        _CLASS.append(of)
    return _CLASS[0]


OWN = ("one", "length", "letters", "capitals", "digits", "symbols", "loud", "punctuation", "word_length", "repeated", "echoed", "touched", "shouted", "doubled", "ended", "small_start")


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of the features :data:`OWN` per line, the lines' lengths, and each text's number of lines.

    Long texts are read in pieces that end with a line; whether a line occurs again is told over the whole text.
    """
    if max((len(t) for t in texts if t), default=0) > LONG:
        parts = [_shapes([p]) for t in texts for p in _lines(t or "")]
        sizes = np.array([sum(1 for _ in _lines(t or "")) for t in texts])
        of = np.repeat(np.arange(len(texts)), sizes)
        own, length, whole = (np.concatenate([p[i] for p in parts]) for i in range(3))
        doc = np.repeat(of, [len(p[1]) for p in parts])
    else:
        own, length, whole, doc = _shapes(texts)
    _, back, times = np.unique(mixed(whole ^ (doc.astype(np.uint64) * GOLDEN)), return_inverse=True, return_counts=True)
    own[:, OWN.index("doubled")] = times[back] > 1
    return own, length, np.bincount(doc, minlength=len(texts))


def _lines(text: str) -> Iterator[str]:
    """Pieces of about :data:`LONG` characters that end where a line does; a longer line is one piece."""
    at = 0
    while len(text) - at > LONG:
        cut = text.rfind("\n", at, at + LONG)
        cut = cut if cut > at else text.find("\n", at + LONG)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def _shapes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (but for whether the line occurs again), lengths, hashes and texts' numbers of the lines that are not blank."""
    parts = [(t or "") + "\n" for t in texts]
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[code]
    ends = np.flatnonzero(kind == END)
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts = [np.add.reduceat((kind == k).astype(np.int32), starts) for k in range(8)]
    doc = np.searchsorted(np.cumsum([len(p) for p in parts]), starts, side="right")
    rolling = Rolling(code)
    solid = np.concatenate([[False], (kind != SPACE) & (kind != END)])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    begin, end = edge[::2], edge[1::2]
    line = np.searchsorted(starts, begin, side="right") - 1
    words = np.bincount(line, minlength=len(starts))
    some = words > 0
    of_word = rolling.of(begin, end)
    n = np.maximum(words, 1)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(line, flag, minlength=len(starts)) / n

    keyed = np.unique(mixed(of_word ^ (line.astype(np.uint64) * GOLDEN)), return_index=True)[1]
    distinct = np.bincount(line[keyed], minlength=len(starts)) / n
    echo = np.zeros(len(begin), bool)
    echo[1:] = (of_word[1:] == of_word[:-1]) & (line[1:] == line[:-1])
    within = {}
    for k in (LOWER, UPPER, SYMBOL, LOUD):
        sums = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        within[k] = sums[end] - sums[begin]
    letters = counts[LOWER] + counts[UPPER]
    size = np.maximum(ends - starts, 1)
    first = np.zeros(len(starts), np.int64)
    last = np.zeros(len(starts), np.int64)
    last[line], first[line[::-1]] = end - 1, begin[::-1]
    loud = counts[LOUD]
    columns = [
        np.ones(len(starts)), np.log1p(size) / 8, letters / size, counts[UPPER] / np.maximum(letters, 1), counts[DIGIT] / size, counts[SYMBOL] / size, np.minimum(1, 10 * loud / size), counts[PUNCTUATION] / size,
        np.minimum(2, share(end - begin) / 10), 1 - distinct, share(echo), share((within[SYMBOL] > 0) | (within[LOUD] > 0)), share((within[UPPER] > 1) & (within[LOWER] == 0)), np.zeros(len(starts)), np.isin(code[last], [ord(c) for c in ".!?:;\"')"]), kind[first] == LOWER,
    ]
    own = np.stack(columns, 1).astype(np.float32)[some]
    return own, (ends - starts)[some], rolling.of(starts, ends)[some], doc[some]


def with_neighbours(own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The features of each line, of the line before and of the line after; zeros where there is none."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    ends = np.cumsum(sizes)
    full = sizes > 0
    before[(ends - sizes)[full]] = 0
    after[(ends - 1)[full]] = 0
    return np.concatenate([own, before, after], 1)


def forward_backward(unary: np.ndarray, transition: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of a good line, and the expected number of each transition; all chains advance side by side.

    ``unary`` is a line's log-odds of good; ``transition[i, j]`` is the weight of label j after label i.
    """
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    many = sizes[order]
    longest = int(many[0]) if len(many) else 0
    active = np.searchsorted(-many, -np.arange(longest), side="left")
    step = np.exp(transition - transition.max())
    shift = np.maximum(unary, 0)
    local = np.exp(np.stack([-shift, unary - shift], 1))
    ahead, behind = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    for t in range(longest):
        at = begin[: active[t]] + t
        now = local[at] if not t else (ahead[at - 1] @ step) * local[at]
        ahead[at] = now / now.sum(1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(longest - 1, -1, -1):
        at = begin[: active[t]] + t
        back = np.full((len(at), 2), 0.5)
        n = active[t + 1] if t + 1 < longest else 0
        if n:
            right = local[at[:n] + 1] * behind[at[:n] + 1]
            now = right @ step.T
            back[:n] = now / now.sum(1, keepdims=True)
            pair = ahead[at[:n], :, None] * step * right[:, None, :]
            expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        behind[at] = back
    both = ahead * behind
    return both[:, 1] / np.maximum(both.sum(1), 1e-300), expected


class Field:
    """The weights of the random field and of the curve from quality to score."""

    def __init__(self, weights: np.ndarray, transition: np.ndarray, curve: tuple[float, float]):
        self.weights, self.transition, self.curve = weights, transition, curve

    def marginals(self, features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return forward_backward(features @ self.weights, self.transition, sizes)[0]

    def quality(self, own: np.ndarray, length: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Length-weighted means of the marginals; 0 for a text without lines."""
        doc = np.repeat(np.arange(len(sizes)), sizes)
        good = self.marginals(with_neighbours(own, sizes), sizes)
        total = np.bincount(doc, length, minlength=len(sizes))
        return np.bincount(doc, length * good, minlength=len(sizes)) / np.maximum(total, 1)

    def score(self, quality: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] * spread(quality) + self.curve[1])))


def spread(quality: np.ndarray) -> np.ndarray:
    q = np.clip(quality, 0.005, 0.995)
    return np.log(q / (1 - q))


def fitted(features: np.ndarray, sizes: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions of the largest penalised likelihood of the labels, by Adam."""
    inner = np.ones(len(good), bool)
    inner[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    here = np.flatnonzero(inner)
    seen = np.bincount(2 * good[here - 1] + good[here], minlength=4).reshape(2, 2)
    theta = np.zeros(features.shape[1] + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        marginal, expected = forward_backward(features @ theta[:-4], theta[-4:].reshape(2, 2), sizes)
        gradient = np.concatenate([features.T @ (marginal - good), (expected - seen).ravel()]) / len(good) + RIDGE * theta
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta = theta - RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0.05, so that the order of qualities stays) and shift of a one-dimensional logistic regression."""
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((p - y) * x).sum() + 0.01 * a, (p - y).sum()])
        hess = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        a, b = np.clip(np.array([a, b]) - np.linalg.solve(hess, grad), -20, 20)
    return max(float(a), 0.05), float(b)


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, lines: int = TRAINING_LINES) -> Field:
    """A field taught by the texts of ``docs`` that ``labels`` (``doc_id, quality``) marks: at most about ``rows``
    labels, chosen by hash, so that they can be broadcast, and of these, in the order of the hash, those whose lines
    together are at most ``lines``; a row teaches with all its lines. A row of more than a ``LONG_ROW``-th of that
    bound does not teach, so that none takes the others' place.

    Null labels, null ids and texts without lines teach nothing; a repeated row teaches as often as it stands there.
    Without rows, or if all have one label, every document scores that label's share.
    """

    def shaped(batches):
        for batch in steps(batches):
            own, length, sizes = line_features(batch.column("text").to_pylist())
            label, order, cuts = batch.column("quality").to_pylist(), batch.column("turn").to_pylist(), np.cumsum(sizes)
            keep = [i for i in range(len(sizes)) if sizes[i]]
            spans = [slice(cuts[i] - sizes[i], cuts[i]) for i in keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array([label[i] for i in keep], pa.int32()), pa.array([order[i] for i in keep], pa.int64()), pa.array(sizes[keep], pa.int64()), pa.array([own[s].tobytes() for s in spans], pa.binary()), pa.array([length[s].astype("<i8").tobytes() for s in spans], pa.binary())],
                ["label", "turn", "n", "own", "length"],
            )

    some = bounded(labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality")), rows, "doc_id")
    learn = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "quality", F.xxhash64(F.lit(5), "doc_id").alias("turn"))
    shapes = written(learn.mapInArrow(shaped, "label int, turn long, n long, own binary, length binary"), "quality-lines")
    shapes = shapes.where(F.col("n") <= lines // LONG_ROW)
    order = shapes.select("turn", "n").toPandas().sort_values(["turn", "n"])  # a row per row that teaches
    fits = order["turn"][(order["n"].cumsum() <= lines).to_numpy()]
    last = int(fits.iloc[-1]) if len(fits) else int(order["turn"].iloc[0]) if len(order) else 0
    got = shapes.where(F.col("turn") <= last).orderBy("turn", "n", "label", "own").toPandas()
    dropped(shapes)
    label = got["label"].to_numpy(np.int64)
    if len(set(label)) < 2:
        share = float(label.mean()) if len(label) else 0.5
        share = min(max(share, 0.001), 0.999)
        return Field(np.zeros(3 * len(OWN)), np.zeros((2, 2)), (0.0, float(np.log(share / (1 - share)))))
    own = np.concatenate([np.frombuffer(x, np.float32).reshape(-1, len(OWN)) for x in got["own"]])
    length = np.concatenate([np.frombuffer(x, "<i8") for x in got["length"]])
    sizes = np.array([len(x) // 8 for x in got["length"]])
    features = with_neighbours(own, sizes).astype(np.float64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    good = label[doc]
    for turn in range(ROUNDS):
        weights, transition = fitted(features, sizes, good)
        field = Field(weights, transition, (1.0, 0.0))
        if turn < ROUNDS - 1:
            marginal = field.marginals(features, sizes)
            worst = np.full(len(sizes), np.inf)
            np.minimum.at(worst, doc, marginal)
            good = np.where(label[doc] == 1, 1, (marginal > 0.5) & (marginal > worst[doc])).astype(np.int64)
    field.curve = logistic(spread(field.quality(own, length, sizes)), label)
    return field


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with ``quality`` (0 to 1), ``score`` (the chance of label 1) and ``n_lines``.

    Null and empty texts, and texts of blanks, have no lines and quality 0; texts of any length are read whole. Repeated
    rows stay; an empty table gives no rows. Columns of ``docs`` that have a result's name give way to it; others
    stay as they are.
    """
    from varigrid.llm.language import ddl

    docs = without(docs, "quality", "score", "n_lines")

    def judged(batches):
        for batch in steps(batches):
            own, length, sizes = line_features(batch.column("text").to_pylist())
            quality = field.quality(own, length, sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(quality), pa.array(field.score(quality)), pa.array(sizes, pa.int64())], [*batch.schema.names, "quality", "score", "n_lines"])

    return docs.mapInArrow(judged, f"{ddl(docs)}, quality double, score double, n_lines long")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    field = trained(docs, labels.where(~held_out(F.col("doc_id"))))
    rows = scored(docs, field)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"), "quality", "n_lines")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(False))
