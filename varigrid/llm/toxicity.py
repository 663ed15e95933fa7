"""Toxicity from gradient-boosted trees over dense features, with isotonic calibration (operator 6).

Features are densities of a fixed lexicon of insults and of a learned one, nearness of insults to words of the
second person, capitals, punctuation, and obfuscation (letters written as digits or signs). The learned lexicon
holds words and word beginnings that are frequent in labelled toxic texts and rare in others; trees see each
training row through the lexicon of the other half, so they do not trust entries that fit one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid.llm.common import bounded, fold, numbered, steps, table, without, written
from varigrid.llm.shingles import GOLDEN, LONG, Rolling, mixed, pieces

#: Bounds: labelled rows that teach, entries of the learned lexicon.
TRAINING_ROWS, ENTRIES = 12_000, 5000
#: An entry of the learned lexicon is in so many toxic texts at least, and its log-odds less one standard error are at least LEAST.
TEXTS, LEAST = 5, 1.2
TREES, DEPTH = 30, 3
NEAR = 5
TOXIC = 0.5
PREFIXES = (4, 6, 8)
#: Insults and profanity in common use.
INSULTS = """
arse arsehole asshole bastard bitch bloody bollocks bullshit clown coward crap creep cretin cunt dickhead disgusting dumb
dumbass dunce fool freak fuck fucker fucking garbage halfwit hate hypocrite idiot idiotic idiots imbecile jackass jerk kill
liar loathsome loser losers lunatic maggot moron moronic morons nasty pathetic pig pigs prick psycho rat retard retarded
rotten scum scumbag shit shitty shut sicko skank slut snake spineless stupid sucker trash trashy twat twit vermin vile
wanker whore worthless wretch
connard connasse conne cretin débile imbécile merde minable ordure pourriture putain salaud salope stupide
arschloch blöd depp drecksau dreck dumm dummkopf idioten miststück penner schlampe scheiße scheisse schwein trottel wichser
basura cabrón estúpido estúpida gilipollas idiota imbécil maldito mierda payaso puta puto tonto
""".split()
#: Words of the second person.
SECOND = "you your yours yourself u ur ya tu te toi ton ta tes vous votre vos du dich dir dein deine euch euer usted ustedes tú ti tus vosotros vuestro".split()
#: Signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
NAMES = ("words", "insult_rate", "insults", "learned_rate", "learned_weight", "learned_most", "second_rate", "near_second", "capitals", "shouted", "loud", "asked", "repeated_marks", "hidden_insults", "mixed_words", "signs")
#: What is counted in a text, or in its pieces: sums but for ``most``.
COUNTS = ("words", "insults", "learned", "weight", "most", "second", "near", "upper", "letters", "tokens", "shouted", "loud", "asked", "again", "hidden", "strange", "marks", "bytes")
MOST = COUNTS.index("most")

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[ord(k) for k in SIGNS]] = [ord(v) for v in SIGNS.values()]
_SIGN = np.zeros(256, bool)
_SIGN[[ord(k) for k in SIGNS]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?.*#$%&"]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = np.concatenate([[False], _WORD[data], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def hashes_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.unique(Rolling(data).of(*word_spans(data)))


def among(values: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``values`` that are keys, and which keys they are."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    hit = np.flatnonzero(sorted_keys[at] == values)
    return hit, at[hit]


class Batch:
    """Words of a batch of texts: spans over the UTF-8 bytes in lower case, hashes, and each word's text."""

    def __init__(self, texts: list[str | None]):
        self.n = len(texts)
        self.raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b"\n".join((t or "").lower().encode("utf-8", "surrogatepass") for t in texts) + b"\n", np.uint8)
        breaks = np.cumsum([len((t or "").lower().encode("utf-8", "surrogatepass")) + 1 for t in texts])
        self.breaks = breaks
        self.rolling = Rolling(self.data)
        self.begin, self.end = word_spans(self.data)
        self.doc = np.searchsorted(breaks, self.begin, side="right")
        self.words = self.rolling.of(self.begin, self.end)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash for every word and every beginning of :data:`PREFIXES` bytes of longer words, and its word."""
        out, of = [self.words], [np.arange(len(self.words))]
        for k in PREFIXES:
            long = np.flatnonzero(self.end - self.begin > k)
            out.append(mixed(self.rolling.of(self.begin[long], self.begin[long] + k) + np.uint64(k * int(GOLDEN) & (1 << 64) - 1)))
            of.append(long)
        return np.concatenate(out), np.concatenate(of)

    def of_docs(self, doc: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc, weight, minlength=self.n).astype(np.float64)


_FIXED: list[np.ndarray] = []


def features(texts: list[str | None], keys: np.ndarray, weights: np.ndarray, version: np.ndarray) -> np.ndarray:
    """The features :data:`NAMES` of each text; ``weights[version]`` are the learned lexicon's weights for it.

    A long text is counted in pieces cut at blanks; words on both sides of a cut are not near each other.
    """
    if max((len(t) for t in texts if t), default=0) > LONG:
        rows = []
        for t, v in zip(texts, version, strict=True):
            parts = np.concatenate([counted([p], keys, weights, np.array([v])) for p in pieces(t or "")])
            total = parts.sum(0, keepdims=True)
            total[0, MOST] = parts[:, MOST].max()
            rows.append(total)
        return shares(np.concatenate(rows))
    return shares(counted(texts, keys, weights, version))


def shares(counts: np.ndarray) -> np.ndarray:
    """The features :data:`NAMES` from the counts :data:`COUNTS`."""
    c = dict(zip(COUNTS, counts.T, strict=True))
    words, size, tokens = np.maximum(c["words"], 1), np.maximum(c["bytes"], 1), np.maximum(c["tokens"], 1)
    columns = [
        np.log1p(words), 100 * c["insults"] / words, np.log1p(c["insults"]), 100 * c["learned"] / words, 100 * c["weight"] / words, c["most"], 100 * c["second"] / words, c["near"], c["upper"] / np.maximum(c["letters"], 1),
        c["shouted"] / tokens, 100 * c["loud"] / size, 100 * c["asked"] / size, 100 * c["again"] / size, c["hidden"], c["strange"] / tokens, c["marks"] / size,
    ]
    return np.stack(columns, 1)


def counted(texts: list[str | None], keys: np.ndarray, weights: np.ndarray, version: np.ndarray) -> np.ndarray:
    """The counts :data:`COUNTS` of each text."""
    if not _FIXED:
        _FIXED.extend((hashes_of(INSULTS), hashes_of(SECOND)))
    b = Batch(texts)
    insult, _ = among(b.words, _FIXED[0])
    second, _ = among(b.words, _FIXED[1])
    near = np.zeros(len(insult), bool)
    if len(second) and len(insult):
        right = np.searchsorted(second, insult)
        for at in (np.minimum(right, len(second) - 1), np.maximum(right - 1, 0)):
            near |= (np.abs(second[at] - insult) <= NEAR) & (b.doc[second[at]] == b.doc[insult])
    hashed, of = b.keys()
    hit, entry = among(hashed, keys)
    learned = np.zeros(len(b.words))
    np.maximum.at(learned, of[hit], weights[version[b.doc[of[hit]]], entry])
    most = np.zeros(b.n)
    np.maximum.at(most, b.doc, learned)

    raw = np.frombuffer(b"\n".join(b.raw) + b"\n", np.uint8)
    start = np.concatenate([[0], np.cumsum([len(x) + 1 for x in b.raw])[:-1]])
    per = lambda flag: np.add.reduceat(flag.astype(np.int64), start) if b.n else np.zeros(0)
    upper = (raw >= 65) & (raw <= 90)
    letter = _LETTER[raw]
    mark = _MARK[raw]
    again = np.concatenate([[False], mark[1:] & (raw[1:] == raw[:-1])])
    solid = np.concatenate([[False], raw > 32, [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    tb, te = edge[::2], edge[1::2]
    of_token = np.searchsorted(start, tb, side="right") - 1
    ups, lows, odd = (np.concatenate([[0], np.cumsum(x)]) for x in (upper, letter & ~upper, ~letter & (raw > 32)))
    shouted = (ups[te] - ups[tb] > 1) & (lows[te] == lows[tb])
    inner = te - tb > 2
    strange = inner & (odd[np.maximum(te - 1, tb + 1)] - odd[np.minimum(tb + 1, te - 1)] > 0) & (ups[te] - ups[tb] + lows[te] - lows[tb] > 1)

    plain = b.data.copy()
    for _ in range(2):  # a sign before a letter stands for a letter; twice for two in a row
        follows = np.concatenate([_LETTER[plain[1:]], [False]])
        swap = _SIGN[plain] & follows
        plain[swap] = _PLAIN[plain[swap]]
    hb, he = word_spans(plain)
    changed = np.concatenate([[0], np.cumsum(plain != b.data)])
    some = changed[he] > changed[hb]
    hidden, _ = among(Rolling(plain).of(hb[some], he[some]), _FIXED[0])
    of_hidden = np.searchsorted(b.breaks, hb[some][hidden], side="right")

    columns = [
        b.of_docs(b.doc), b.of_docs(b.doc[insult]), b.of_docs(b.doc[learned > 0]), b.of_docs(b.doc, learned), most, b.of_docs(b.doc[second]), b.of_docs(b.doc[insult[near]]), per(upper), per(letter), b.of_docs(of_token), b.of_docs(of_token, shouted),
        per(raw == 33), per(raw == 63), per(again), b.of_docs(of_hidden), b.of_docs(of_token, strange), per(mark), np.array([len(x) for x in b.raw], np.float64),
    ]
    return np.stack(columns, 1)


def lexicon(learn: DataFrame, entries: int = ENTRIES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, and their weights as learned from half 0, from half 1 and from both (0 where not in a lexicon).

    ``learn`` has ``text``, ``label`` and ``half``. Counts over toxic texts choose at most ``entries`` keys; the
    other texts are then counted for these alone.
    """

    def toxic(batches):
        for batch in steps(batches):
            b = Batch(batch.column("text").to_pylist())
            half = np.array(batch.column("half").to_pylist(), np.int64)
            hashed, of = b.keys()
            doc, key = b.doc[of], hashed
            order = np.lexsort((doc, key))
            doc, key = doc[order], key[order]
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, which = key[first], half[doc[first]]
            own = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            ones = np.add.reduceat(which, own) if len(own) else np.zeros(0, np.int64)
            all_ = np.diff(own, append=len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key[own].view(np.int64)), pa.array(all_ - ones), pa.array(ones)], ["key", "a", "b"])

    counts = learn.where("label = 1").mapInArrow(toxic, "key long, a long, b long").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") + F.col("b") >= TEXTS)
    chosen = counts.orderBy((F.col("a") + F.col("b")).desc(), "key").limit(entries).toPandas()
    keys = chosen["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, ones = keys[order], chosen[["a", "b"]].to_numpy(np.float64)[order]

    def other(batches):
        total = np.zeros((len(keys), 2), np.int64)
        for batch in steps(batches):
            b = Batch(batch.column("text").to_pylist())
            half = np.array(batch.column("half").to_pylist(), np.int64)
            hashed, of = b.keys()
            hit, entry = among(hashed, keys)
            pair = np.unique(entry * np.int64(b.n) + b.doc[of[hit]])
            np.add.at(total, (pair // max(b.n, 1), half[pair % max(b.n, 1)]), 1)
        some = np.flatnonzero(total.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some, 0]), pa.array(total[some, 1])], ["i", "a", "b"])

    rest = np.zeros((len(keys), 2))
    got = learn.where("label = 0").mapInArrow(other, "i long, a long, b long").groupBy("i").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()
    rest[got["i"].to_numpy(np.int64)] = got[["a", "b"]].to_numpy(np.float64)
    sizes = {(r["label"], r["half"]): r["n"] for r in learn.groupBy("label", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = np.array([[sizes.get((k, h), 0) for h in (0, 1)] for k in (0, 1)], np.float64)
    weights = np.zeros((3, len(keys)))
    for v, halves in enumerate(([0], [1], [0, 1])):
        n1, n0 = ones[:, halves].sum(1), rest[:, halves].sum(1)
        odds = np.log((n1 + 0.5) / (total[1, halves].sum() + 1)) - np.log((n0 + 0.5) / (total[0, halves].sum() + 1))
        error = np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
        weights[v] = np.where((odds - error >= LEAST) & (n1 >= TEXTS / 2), odds, 0)
    used = np.flatnonzero(weights.any(0))
    return keys[used], weights[:, used]


def featured(docs: DataFrame, keys: np.ndarray, weights: np.ndarray, version: str | None = None) -> DataFrame:
    """``docs`` without ``text`` but with ``_features``; ``version`` names the column that picks the weights."""
    rest = docs.drop("text")
    names = rest.columns

    def shaped(batches):
        for batch in steps(batches):
            which = np.array(batch.column(version).to_pylist(), np.int64) if version else np.full(batch.num_rows, 2)
            rows = features(batch.column("text").to_pylist(), keys, weights, which)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), values], [*names, "_features"])

    from varigrid.llm.language import ddl

    return docs.mapInArrow(shaped, f"{ddl(rest)}, _features array<double>")


def scored(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """``docs`` without ``text`` but with ``score``, the calibrated chance of label 1; ``labels`` has ``doc_id, toxic``.

    At most about ``rows`` labels teach, chosen by hash. Three quarters of them grow the trees and the rest
    calibrate. A thousandth of the score is the trees' own, so that equal calibrated scores keep their order.
    Null texts are empty. Without labels, or if all are equal, every document scores their share (0 without
    any). Repeated rows and rows without an id stay; texts of any length are read whole; an empty table gives no rows.
    A column ``score`` of ``docs`` gives way to the result; others stay as they are, whatever their names.
    """
    docs = without(docs, "score")
    rest = docs.drop("text")
    some = bounded(labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("label")), rows, "doc_id")
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(8))
    learn = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "label", (draw % 2).cast("int").alias("half"), (draw < 6).alias("grows"))
    learn = written(learn, "toxicity-rows")
    sizes = {(r["label"], r["grows"]): r["n"] for r in learn.groupBy("label", "grows").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len({k for k, grows in sizes if grows}) < 2:
        share = sum(n for (k, _), n in sizes.items() if k) / max(1, sum(sizes.values()))
        return rest.withColumn("score", F.lit(float(share)))
    keys, weights = lexicon(learn)
    other = learn.select("text", "label", "grows", (1 - F.col("half")).alias("version"))
    train = written(featured(other, keys, weights, "version").coalesce(4), "toxicity-features")
    train = train.select(array_to_vector("_features").alias("_features"), F.col("label").cast("double").alias("label"), "grows")
    grower = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, maxBins=64, seed=7, featuresCol="_features", predictionCol="_tree").setRawPredictionCol("_raw").setProbabilityCol("_chance")
    trees = grower.fit(train.where("grows"))
    margin = vector_to_array("_raw")[1]
    held = trees.transform(train.where("not grows")).select("label", margin.alias("_margin"))
    if len({k for k, grows in sizes if not grows}) < 2:
        held = trees.transform(train).select("label", margin.alias("_margin"))
    curve = IsotonicRegression(featuresCol="_margin", labelCol="label", predictionCol="_even").fit(held)
    rows_ = featured(numbered(docs, keep=("text",)), keys, weights).withColumn("_features", array_to_vector("_features"))
    judged = curve.transform(trees.transform(rows_).withColumn("_margin", margin))
    score = 0.999 * F.least(F.greatest("_even", F.lit(0.0)), F.lit(1.0)) + 0.001 * vector_to_array("_chance")[1]
    names = [n for n in numbered(docs, keep=("text",)).columns if n != "text"]
    return judged.select(*(F.col(n).alias(c) for n, c in zip(names, rest.columns, strict=True)), score.alias("score"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 5) == 0, F.lit(False))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    rows = scored(docs, labels.where(~held_out(F.col("doc_id"))))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
