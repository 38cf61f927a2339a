"""Toxicity: a factorization machine over hashed terms.

A text's terms are its distinct words and the beginnings of longer words (insults are inflected), as 64-bit hashes. A
document's score is the logistic of `bias + sum w_i + sum over pairs i < j of <v_i, v_j>` over the terms it has: pairs
that matter only together, an insult and a mention of a group, count without a weight for every pair.

1. Spark counts, over all labelled training texts, in how many toxic and clean ones each term stands; tasks send sums.
2. Terms that go with the label more than chance explains (log-likelihood ratio above 2 ln of the number of terms, so
   that about one term passes by chance) get weights; the TERMS strongest at most, which is the size of the model.
3. The weights are fitted to SAMPLE labelled texts at most, of which only those terms are kept.
4. All texts are scored by one pass; the model travels with it: TERMS * (8 + 8 * (2 + FACTORS)) bytes at most, 3.7 MB.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm import kernels as K
from cairnspark.llm.shared import aside, made, small_batches, sweep, table, written

TERMS = 1 << 16
FACTORS = 4
#: Labelled texts that the weights are fitted to; the smallest hashes are taken.
SAMPLE = 20_000
#: Labelled texts whose keys (20 bytes each) are sent to every task.
LABELS = 1_000_000
#: Beginnings of words that are terms, of words longer than that.
BEGINNINGS = (4, 5)
#: Distinct terms that a task counts before it sends its sums.
HELD = 1 << 20
STRENGTH = 1.0
EPOCHS, RATE, DECAY = 300, 0.05, 1e-4
_WORD = re.compile(r"[^\W\d_]+")


#: Words whose hashes a worker keeps at a time, as texts share most of theirs.
REMEMBERED = 200_000
_HASHES: dict[str, tuple[int, ...]] = {}


def _hashes(word: str) -> tuple[int, ...]:
    """The hashed terms of a word: itself, and its beginnings if it is longer."""
    out = _HASHES.get(word)
    if out is None:
        if len(_HASHES) >= REMEMBERED:
            _HASHES.clear()
        out = _HASHES[word] = tuple(xxhash.xxh3_64_intdigest(t) >> 1 for t in (word, *(f"{word[:n]}^" for n in BEGINNINGS if len(word) > n)))
    return out


def _words(text: str | None) -> set[str]:
    """The distinct words of a text: runs of letters, lower-cased."""
    return set(_WORD.findall(text.lower())) if text else set()


def terms(text: str | None) -> np.ndarray:
    """The distinct hashed terms of a text, sorted."""
    found = {h for w in _words(text) for h in _hashes(w)}
    return np.sort(np.fromiter(found, np.int64, len(found)))


@dataclass
class Machine:
    """Terms (sorted hashes), their weights and factors, and the bias; prior is the share of toxic labels."""

    keys: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def logit(self, at: np.ndarray) -> float:
        """The score, before the logistic, of a text with the terms at these places of `keys`."""
        v = self.factors[at]
        s = v.sum(axis=0)
        return float(self.bias + self.weights[at].sum() + 0.5 * ((s * s).sum() - (v * v).sum()))

    def scorer(self) -> Callable[[str | None], float]:
        """A function from texts to scores that remembers which words have weights: most have none."""
        place, known = {int(k): i for i, k in enumerate(self.keys)}, {}

        def places(word: str) -> tuple[int, ...]:
            found = known.get(word)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = known[word] = tuple(place[h] for h in _hashes(word) if h in place)
            return found

        def score(text: str | None) -> float:
            at = sorted({p for w in _words(text) for p in places(w)})
            return _logistic(self.logit(np.array(at, np.int64)))

        return score

    def score(self, text: str | None) -> float:
        return self.scorer()(text)


def _logistic(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(keys: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS) -> Machine:
    """Weights for texts given as places in `keys`, by gradient descent on the log loss with Adam steps; deterministic."""
    n, rng = len(keys), np.random.default_rng(13)
    place = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    params = {"b": np.array([np.log(share / (1 - share))]), "w": np.zeros(n), "v": rng.normal(0, 0.05, (n, factors))}
    first, second = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))

    def by_row(values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(row, values[:, f], len(rows)) for f in range(values.shape[1])], axis=1)

    for step in range(1, epochs + 1):
        w, v = params["w"], params["v"]
        here = v[place]
        sums = by_row(here)
        z = params["b"][0] + np.bincount(row, w[place], len(rows)) + 0.5 * ((sums**2).sum(1) - by_row(here**2).sum(1))
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / max(1, len(rows))
        slope = error[row]
        pull = slope[:, None] * (sums[row] - here)
        grads = {
            "b": np.array([error.sum()]),
            "w": np.bincount(place, slope, n) + DECAY * w,
            "v": np.stack([np.bincount(place, pull[:, f], n) for f in range(factors)], axis=1) + DECAY * v,
        }
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(keys, params["w"], params["v"], float(params["b"][0]))


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, keys): (text, key, toxic) of documents with a label, and (key, doc_id, toxic) of the same without texts.

    Equal texts count once, by their smallest doc_id. A doc_id's label, and a text's, is what at least half of its labels
    say; null labels and ids say nothing. Texts are hashed before they meet labels; where the keys are LABELS at most,
    they are sent to the texts, else both are dealt by key.
    """
    said = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    texts = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    keys = texts.select("doc_id", "key").join(said, "doc_id").groupBy("key").agg(F.min("doc_id").alias("doc_id"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    keys = written(keys, "toxicity-keys")
    small = keys.limit(LABELS + 1).count() <= LABELS
    return texts.join(F.broadcast(keys) if small else keys, ["doc_id", "key"]).select("text", "key", "toxic"), keys


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, toxic, clean): in how many of the labelled rows (text, toxic) of either kind each term stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            key, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            bad = np.concatenate([b for _, b in held])
            held.clear()
            size = 0
            counts = [np.bincount(at, w, len(key)).astype(np.int64) for w in (bad, 1 - bad)]
            return pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(c) for c in counts)], ["term", "toxic", "clean"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = terms(text.as_py())
                held.append((found, np.full(len(found), toxic, np.int64)))
                size += len(found)
                if size > HELD:
                    yield flush()
        if held:
            yield flush()

    return rows.select("text", "toxic").mapInArrow(K.tidy(run), "term long, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _part(seen: Column, expected: Column) -> Column:
    return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)


def telling_terms(counts: DataFrame, toxic: int, clean: int) -> DataFrame:
    """The terms whose log-likelihood ratio with the label is above 2 ln of the number of terms, with it, the strongest first."""
    tried = max(2, counts.count())
    a, b = F.col("toxic"), F.col("clean")
    share = (a + b) / float(toxic + clean)
    parts = [_part(a, share * toxic), _part(b, share * clean), _part(toxic - a, (1 - share) * toxic), _part(clean - b, (1 - share) * clean)]
    ratio = 2 * (parts[0] + parts[1] + parts[2] + parts[3])
    return counts.select("term", ratio.alias("ratio")).where(F.col("ratio") > STRENGTH * np.log(tried)).orderBy(F.desc("ratio"), "term").limit(TERMS)


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """A machine learnt from the labelled documents. Without a label of either kind it has no terms: score 0 without toxic rows."""
    spark = docs.sparkSession
    small_batches(spark)
    mark = made()
    rows, chosen = labelled(docs, labels)
    n = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    none = np.zeros(0, np.int64)
    if not toxic or not clean:
        sweep(spark, mark)
        return Machine(none, np.zeros(0), np.zeros((0, FACTORS)), np.inf if toxic else -np.inf)
    counts = written(term_counts(rows), "toxicity-terms")
    keys = np.sort(np.array([r["term"] for r in telling_terms(counts, toxic, clean).collect()], np.int64))  # TERMS rows at most

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t.as_py()) for t in batch.column(0)]
            at = [np.searchsorted(keys, f) for f in found]
            kept = [a[keys[np.minimum(a, len(keys) - 1)] == f] if len(keys) else none for a, f in zip(at, found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.list_(pa.int64())), batch.column(1)], ["places", "toxic"])

    last = chosen.select("key").orderBy("key").limit(SAMPLE).agg(F.max("key")).first()[0]
    sample = rows.where(F.col("key") <= last).select("text", "toxic").mapInArrow(K.tidy(places), "places array<long>, toxic int").collect()
    sweep(spark, mark)
    sample.sort(key=lambda r: (r["toxic"], r["places"]))
    return fit(keys, [np.array(r["places"], np.int64) for r in sample], np.array([r["toxic"] for r in sample], float))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with score and predicted (1 if the score is 0.5 or more) by the column text alone; one row in, one row out.

    A null text scores as an empty one. Columns of the caller named score or predicted are kept as score_in and so on.
    """
    small_batches(docs.sparkSession)
    docs = aside(docs, "score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = machine.scorer()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            scores = np.array([score(t.as_py()) for t in texts], float)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"]
            )

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(K.tidy(run), f"{base}, score double, predicted int")


def held_out() -> Column:
    """Whether a row's label is kept from training: crc32 of its doc_id modulo 5 is 0. A null id has the crc32 of no text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by its whole text.

    Nulls: a null text scores as an empty one, a null id has no label. Repeated rows are scored each; they are one row of
    the training. An empty table of labels gives scores of 0; an empty table of documents gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    machine = train(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", held_out().alias("held_out"), "text"), machine).select("doc_id", "held_out", "score", "predicted")
