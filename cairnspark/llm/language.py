"""Language identification with interpolated Kneser-Ney character models.

Per language, an order-4 character model over words: every word is padded with three word marks in front and one
behind. Spark counts the four-grams of all training words, and works out continuation counts, discounts (n1 / (n1 + 2 n2)
of each order), probabilities and back-off weights by grouping and joining over (language, gram) rows; nothing is cut off.
The model is sorted arrays of 64-bit n-gram hashes with one column of log-probabilities per language; texts are scored by
binary search, each distinct word of a slice once. A model of more than MODEL_BYTES stays a table, and distinct words are
scored by joins with it: the same numbers by another way. The language is that of the lowest cross-entropy per character.

Confidence is a softmax over the per-character cross-entropies. Its temperature, and the cross-entropy of each language
beyond which texts are rejected, are fitted to labelled rows that were left out of the counts.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnspark.llm import kernels as K
from cairnspark.llm.shared import small_batches, table, written

ORDER = 4
#: Discount where an order has no grams of count one or two.
DISCOUNT = 0.75
PAD = "\x01"
#: Models of up to this size are sent to every task.
MODEL_BYTES = 256 << 20
#: Bounds of the calibration sample: share of a language's rows, and rows a language. No other row is left out of the counts.
CALIBRATION_SHARE, CALIBRATION_ROWS = 0.1, 5000
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of ASCII letters and non-ASCII bytes."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    word = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Distinct runs, lower-cased and with non-letters as blanks, and for each run its place in that list."""
    h = K.word_hashes(data, start, end)
    _, one, place = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    text = [raw[a:b].decode("utf-8", "ignore").lower() for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
    return [w if w.isalpha() else letters(w) for w in text], place


def letters(w: str) -> str:
    """The runs of letters, with the marks that go with them, joined by blanks."""
    kept = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in w)
    return " ".join(p for p in kept.split() if any(c.isalpha() for c in p))


def gram_codes(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each character (and at the end mark) of each word, a column per length 1..order.

    Also the word's place for each row. A word of several letter runs is scored run by run.
    """
    pieces = [PAD * (order - 1) + w.replace(" ", PAD + PAD * (order - 1)) + PAD if w else "" for w in words]
    size = np.array([len(p) for p in pieces], np.int64)
    codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(pieces)), size)
    first = np.cumsum(size) - size
    at = np.arange(len(codes))
    inner = at - first[owner] >= order - 1
    # Marks that pad a later run of the same word are context only.
    inner[1:] &= ~((codes[1:] == 1) & (codes[:-1] == 1))
    at = at[inner]
    out = np.empty((len(at), order), np.uint64)
    h = np.zeros(len(at), np.uint64)
    for n in range(order):
        h = K.mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[at - n] + np.uint64(1))
        out[:, n] = h
    return out, owner[at]


def gram_table(words: list[str], weight: np.ndarray, order: int = ORDER) -> dict[str, int]:
    """Counts of the four-grams (as strings) of weighted words."""
    total: dict[str, int] = {}
    for w, n in zip(words, weight.tolist(), strict=True):
        for part in w.split():
            p = PAD * (order - 1) + part + PAD
            for i in range(len(p) - order + 1):
                g = p[i : i + order]
                total[g] = total.get(g, 0) + n
    return total


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over every row of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[str, int]] = {}

        def flush():
            for lang, grams in total.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(list(grams)), pa.array(list(grams.values()), pa.int64())],
                    ["lang", "gram", "n"],
                )
            total.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b, data, offsets in K.slices(batch.column(1), 1 << 20):
                s, e, row = runs(data, offsets)
                words, place = distinct_words(data, s, e)
                names, code = np.unique(np.array(langs[a:b], dtype=object), return_inverse=True)
                at = code[row]
                for i, name in enumerate(names):
                    n = np.bincount(place[at == i], minlength=len(words))
                    used = np.flatnonzero(n)
                    own = total.setdefault(name, {})
                    for g, c in gram_table([words[j] for j in used], n[used]).items():
                        own[g] = own.get(g, 0) + c
            if sum(map(len, total.values())) > 200_000:
                yield from flush()
        yield from flush()

    return rows.select("lang", "text").mapInArrow(K.tidy(run), "lang string, gram string, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")
    )


@dataclass
class Model:
    """Sorted hash arrays: grams[n] and their log-probabilities, contexts[n] and their log back-off weights.

    Where the model is too large for that, the arrays are empty and rows is the table of it: (context, n, key, value).
    """

    langs: list[str]
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray
    sharpness: float = 12.0
    limit: np.ndarray | None = None
    rows: DataFrame | None = None

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-probability per word and language, and scored characters per word."""
        codes, owner = gram_codes(words)
        total = np.zeros((len(codes), len(self.langs)))
        left = np.arange(len(codes))
        for n in range(ORDER, 0, -1):
            at, found = _find(self.grams[n - 1], codes[left, n - 1])
            total[left[found]] += self.logp[n - 1][at[found]]
            left = left[~found]
            if not len(left):
                break
            if n > 1:
                # The context of the last character's n-gram is the (n - 1)-gram that ends one character earlier.
                ctx = _context_codes(codes, owner, left, n - 1)
                at, found = _find(self.contexts[n - 2], ctx)
                total[left[found]] += self.backoff[n - 2][at[found]]
        total[left] += self.floor
        out = np.zeros((len(words), len(self.langs)))
        for j in range(len(self.langs)):
            out[:, j] = np.bincount(owner, total[:, j], minlength=len(words))
        return out, np.bincount(owner, minlength=len(words))


def _context_codes(codes: np.ndarray, owner: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters before each row's character; at a word's first character they are all marks."""
    marks = np.uint64(0)
    pad = np.zeros(1, np.uint64)
    for _ in range(n):
        pad = K.mix(pad * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1) + np.uint64(1))
    marks = pad[0]
    before = np.maximum(rows - 1, 0)
    same = (rows > 0) & (owner[before] == owner[rows])
    return np.where(same, codes[before, n - 1], marks)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _hash(grams: list[str]) -> np.ndarray:
    """The hash that gram_codes gives an n-gram (last character first)."""
    if not grams:
        return np.zeros(0, np.uint64)
    n = len(grams[0])
    codes = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, n)
    h = np.zeros(len(grams), np.uint64)
    for i in range(n - 1, -1, -1):
        h = K.mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[:, i] + np.uint64(1))
    return h


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, int]:
    """(lang, n, gram, p, context, weight) for all orders of (lang, gram, n) four-gram counts, and the alphabet's size.

    Below the highest order, a gram counts as often as there are different characters before it. weight is what the
    gram's context leaves to the order below.
    """
    level = counts.select("lang", "gram", F.col("n").cast("double").alias("c"))
    levels = [level]
    for _ in range(ORDER - 1):
        level = level.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).cast("double").alias("c"))
        levels.insert(0, level)
    alphabet = max(2, levels[0].select("gram").distinct().count() + 1)
    out = []
    for n, level in enumerate(levels, 1):
        x = level.withColumn("context", F.substring("gram", 1, n - 1) if n > 1 else F.lit(""))
        ones, twos = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
        cut = F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(F.lit(DISCOUNT))
        x = x.join(x.groupBy("lang").agg(cut.alias("d")), "lang")
        here = W.partitionBy("lang", "context")
        x = x.withColumn("total", F.sum("c").over(here)).withColumn("weight", F.col("d") * F.count(F.lit(1)).over(here) / F.col("total"))
        if n == 1:
            x = x.withColumn("below", F.lit(1.0 / alphabet))
        else:
            lower = out[-1].select("lang", F.col("gram").alias("rest"), F.col("p").alias("below"))
            x = x.withColumn("rest", F.expr("substring(gram, 2)")).join(lower, ["lang", "rest"])
        p = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("below")
        out.append(written(x.select("lang", F.lit(n).alias("n"), "gram", p.alias("p"), "context", "weight"), f"kneser-ney-{n}"))
    return reduce(DataFrame.union, out), alphabet


def _hashed(rows: DataFrame) -> DataFrame:
    """(context, n, key, value) of rows (context boolean, n, gram, value): grams by the hash of gram_codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, n = batch.column(2).to_pylist(), np.asarray(batch.column(1))
            key = np.zeros(len(grams), np.uint64)
            for k in np.unique(n).tolist():
                at = np.flatnonzero(n == k)
                key[at] = _hash([grams[i] for i in at])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key.view(np.int64)), batch.column(3)], ["context", "n", "key", "value"])

    return rows.mapInArrow(K.tidy(run), "context boolean, n int, key long, value array<float>")


def model_rows(levels: DataFrame, langs: list[str], alphabet: int) -> DataFrame:
    """(context, n, key, value): per gram the log-probability in every language, per context the log back-off weight.

    A language that lacks a gram backs off, with weight one where it lacks the context too.
    """
    every = F.array(*[F.lit(x) for x in langs])

    def by_lang(value: Column) -> Column:
        return F.map_from_entries(F.collect_list(F.struct(F.col("lang"), F.log(value).alias("v"))))

    parts, lower = [], None
    for n in range(1, ORDER + 1):
        x = levels.where(F.col("n") == n)
        # One gram of each context speaks for it: the same language's weights are equal.
        contexts = x.groupBy("context", "lang").agg(F.first("weight").alias("weight")).groupBy("context").agg(by_lang(F.col("weight")).alias("w"))
        grams = x.groupBy("gram").agg(by_lang(F.col("p")).alias("m"), F.first("context").alias("context")).join(contexts, "context", "left")
        if n == 1:
            grams = grams.withColumn("below", F.array_repeat(F.lit(math.log(1.0 / alphabet)), len(langs)))
        else:
            grams = grams.withColumn("rest", F.expr("substring(gram, 2)")).join(lower.select(F.col("gram").alias("rest"), F.col("value").alias("below")), "rest")
        value = F.transform(every, lambda x, i: F.coalesce(F.element_at("m", x), F.coalesce(F.element_at("w", x), F.lit(0.0)) + F.get("below", i)))
        lower = written(grams.select("gram", value.alias("value")), f"log-probabilities-{n}")
        parts.append(lower.select(F.lit(False).alias("context"), F.lit(n).alias("n"), "gram", F.col("value").cast("array<float>").alias("value")))
        if n > 1:
            weights = F.transform(every, lambda x: F.coalesce(F.element_at("w", x), F.lit(0.0))).cast("array<float>")
            parts.append(contexts.select(F.lit(True).alias("context"), F.lit(n - 1).alias("n"), F.col("context").alias("gram"), weights.alias("value")))
    return _hashed(reduce(DataFrame.union, parts))


def fit_counts(counts: DataFrame) -> Model:
    """The model of (lang, gram, n) four-gram counts."""
    counts = written(counts, "four-grams")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())  # one row per language
    if not langs:
        return Model([], [], [], [], [], np.zeros(0))
    levels, alphabet = kneser_ney(counts)
    rows = written(model_rows(levels, langs, alphabet), "language-model")
    first = {r[0]: r[1] for r in levels.where("n = 1").groupBy("lang").agg(F.first("weight")).collect()}
    floor = np.array([math.log(first[x] / alphabet) for x in langs])
    if rows.count() * (8 + 4 * len(langs)) > MODEL_BYTES:
        return Model(langs, [], [], [], [], floor, rows=rows)
    found = rows.toArrow()
    context, n, key = (np.asarray(found[c].combine_chunks()) if c != "context" else found[c].to_numpy() for c in ("context", "n", "key"))
    value = np.asarray(found["value"].combine_chunks().flatten()).reshape(len(key), len(langs))
    key, parts = key.view(np.uint64), []
    for kind, orders in ((False, range(1, ORDER + 1)), (True, range(1, ORDER))):
        for k in orders:
            at = np.flatnonzero((n == k) & (context == kind))
            at = at[np.argsort(key[at])]
            parts.append((key[at], value[at]))
    keys, values = [p[0] for p in parts], [p[1] for p in parts]
    return Model(langs, keys[:ORDER], values[:ORDER], keys[ORDER:], values[ORDER:], floor)


def slice_entropies(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character of each row and language, and scored characters (0: the row has no letter)."""
    n_rows = len(offsets) - 1
    s, e, row = runs(data, offsets)
    total, chars = np.zeros((n_rows, len(model.langs))), np.zeros(n_rows)
    if len(s):
        words, place = distinct_words(data, s, e)
        score, size = model.score(words)
        for j in range(len(model.langs)):
            total[:, j] = np.bincount(row, score[place, j], minlength=n_rows)
        chars = np.bincount(row, size[place], minlength=n_rows)
    return -total / np.maximum(chars, 1)[:, None], chars


def _sent_entropies(rows: DataFrame, columns: list[str], model: Model) -> DataFrame:
    """rows' columns with chars and h, the scored characters and cross-entropies of text, by a model sent to every task."""
    box = rows.sparkSession.sparkContext.broadcast(model)  # at most MODEL_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = box.value
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column(0), 1 << 20):
                h, chars = slice_entropies(m, data, offsets)
                own = [batch.column(i).slice(a, b - a) for i in range(1, len(columns) + 1)]
                wide = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * len(m.langs), pa.int32()), pa.array(h.ravel()))
                yield pa.RecordBatch.from_arrays([*own, pa.array(chars), wide], [*columns, "chars", "h"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.select(F.col("text").alias("__text"), *columns).mapInArrow(K.tidy(run), f"{kinds}, chars double, h array<double>")


def _joined_entropies(rows: DataFrame, columns: list[str], model: Model) -> DataFrame:
    """The same by joins with the table of a model of any size: distinct words meet it, and texts meet their words."""
    row = F.xxhash64("text").alias("row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column(0), 1 << 20):
                s, e, at = runs(data, offsets)
                words, place = distinct_words(data, s, e)
                pair, n = np.unique(at * len(words) + place, return_counts=True) if len(words) else (np.zeros(0, np.int64),) * 2
                owner, word = pair // max(1, len(words)), pair % max(1, len(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(pa.array(owner + a)), pa.array([words[i] for i in word.tolist()], pa.string()), pa.array(n)], ["row", "word", "n"]
                )

    texts = rows.where("text is not null").select("text", row).dropDuplicates(["row"])
    held = written(texts.mapInArrow(K.tidy(cut), "row long, word string, n long").where("word <> ''").groupBy("row", "word").agg(F.sum("n").alias("n")), "text-words")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            codes, owner = gram_codes(words)
            every = np.arange(len(codes))
            keys = [codes[:, n - 1] for n in range(1, ORDER + 1)] + [_context_codes(codes, owner, every, n) for n in range(1, ORDER)]
            kinds = [(False, n) for n in range(1, ORDER + 1)] + [(True, n) for n in range(1, ORDER)]
            for (context, n), key in zip(kinds, keys, strict=True):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([words[i] for i in owner.tolist()], pa.string()), pa.array(every.astype(np.int32)),
                        pa.array(np.full(len(key), context)), pa.array(np.full(len(key), n, np.int32)), pa.array(key.view(np.int64)),
                    ],
                    ["word", "pos", "context", "n", "key"],
                )

    words = held.select("word").distinct().mapInArrow(K.tidy(look), "word string, pos int, context boolean, n int, key long")
    met = words.join(model.rows, ["context", "n", "key"], "left").groupBy("word", "pos").agg(
        *[F.max(F.when((F.col("n") == n) & ~F.col("context"), F.col("value"))).alias(f"g{n}") for n in range(1, ORDER + 1)],
        *[F.max(F.when((F.col("n") == n) & F.col("context"), F.col("value"))).alias(f"c{n}") for n in range(1, ORDER)],
    )

    def one(i: int) -> Column:
        """The log-probability of a character in language i: the longest known gram, after the weights passed by."""
        passed, value = F.lit(0.0), None
        for n in range(ORDER, 0, -1):
            here = (F.col(f"g{n}").isNotNull(), F.get(f"g{n}", F.lit(i)).cast("double") + passed)
            value = F.when(*here) if value is None else value.when(*here)
            if n > 1:
                passed = passed + F.coalesce(F.get(f"c{n - 1}", F.lit(i)).cast("double"), F.lit(0.0))
        return value.otherwise(passed + F.lit(float(model.floor[i])))

    size = range(len(model.langs))
    scores = met.groupBy("word").agg(F.count(F.lit(1)).alias("chars"), *[F.sum(one(i)).alias(f"s{i}") for i in size])
    total = held.join(scores, "word").groupBy("row").agg(
        F.sum(F.col("n") * F.col("chars")).cast("double").alias("chars"), *[F.sum(F.col("n") * F.col(f"s{i}")).alias(f"s{i}") for i in size]
    )
    total = total.select("row", "chars", F.array(*[-F.col(f"s{i}") / F.col("chars") for i in size]).alias("h"))
    none = F.array_repeat(F.lit(0.0), len(model.langs))
    return rows.join(total, F.xxhash64("text") == total["row"], "left").select(
        *columns, F.coalesce("chars", F.lit(0.0)).alias("chars"), F.coalesce("h", none).alias("h")
    )


def entropies(rows: DataFrame, columns: list[str], model: Model) -> DataFrame:
    return (_sent_entropies if model.rows is None else _joined_entropies)(rows, columns, model)


def train(labelled: DataFrame) -> Model:
    """A model of the non-null languages of (doc_id, lang, text).

    Counts are over all rows but the calibration sample: at most a tenth of a language's rows, and CALIBRATION_ROWS.
    Languages whose rows have no letter, and empty tables, give no language.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(CALIBRATION_SHARE), F.lit(CALIBRATION_ROWS) / F.col("n"))
    dealt = rows.join(F.broadcast(sizes), "lang")  # one row per language
    dealt = dealt.withColumn("held", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share * 1_000_000)
    model = fit_counts(count_grams(dealt.where("not held")))
    if model.langs:
        sample = dealt.where("held").where(F.col("lang").isin(model.langs))
        sample = entropies(sample, ["lang"], model).where("chars > 0").select("lang", "chars", "h").toArrow()
        _calibrate(model, sample["lang"].to_pylist(), sample["chars"].to_numpy(), sample["h"].to_pylist())
    return model


def _calibrate(model: Model, langs: list[str], chars: np.ndarray, found: list[list[float]]) -> None:
    """Temperature with the best likelihood of the true languages; per language, the entropy beyond which to reject."""
    h = np.array(found, float).reshape(len(langs), len(model.langs))
    true = np.searchsorted(model.langs, langs) if langs else np.zeros(0, int)
    best = (math.inf, model.sharpness)
    for k in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0):
        z = -k * (h - h.min(1, keepdims=True))
        best = min(best, (-np.mean(z[np.arange(len(h)), true] - np.log(np.exp(z).sum(1))), k)) if len(h) else best
    model.sharpness = best[1]
    pick, limit = h.argmin(1) if len(h) else np.zeros(0, int), np.full(len(model.langs), np.inf)
    for i in range(len(model.langs)):
        own = h[(true == i) & (pick == i) & (chars >= 40), i]
        if len(own) >= 20:
            middle, spread = np.median(own), np.quantile(own, 0.75) - np.quantile(own, 0.25)
            limit[i] = max(np.quantile(own, 0.999), middle + 8 * spread) + 0.25
    model.limit = limit


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, accepted): `und` with score 0, rejected, for null texts and texts without a letter.

    score is the calibrated confidence in 0..1; accepted is false where the cross-entropy is above the language's limit.
    One row out for each row in, whatever its doc_id; of equal entropies the first language by name wins. A text of any
    length is scored whole. Columns other than doc_id and text are left out, so their names cannot clash.
    """
    if not model.langs:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    best, least, accepted = _decision(model)
    others = F.aggregate("h", F.lit(0.0), lambda z, x: z + F.exp(-model.sharpness * (x - least)))
    told = F.col("chars") > 0
    return entropies(docs.select("doc_id", "text"), ["doc_id"], model).select(
        "doc_id", F.when(told, F.element_at(F.array(*[F.lit(x) for x in model.langs]), best)).otherwise("und").alias("lang_pred"),
        F.when(told, 1.0 / others).otherwise(0.0).alias("score"), accepted.alias("accepted"),
    )


def _decision(model: Model) -> tuple[Column, Column, Column]:
    """Place of the language with the least cross-entropy, that cross-entropy, and whether the text is accepted."""
    least = F.array_min("h")
    best = F.array_position("h", least).cast("int")
    limit = F.element_at(F.array(*[F.lit(float(x)) for x in model.limit]), best)
    return best, least, (F.col("chars") > 0) & (least <= limit)


def accepted_rows(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text is accepted, with their own columns: none without a language."""
    if not model.langs:
        return docs.limit(0)
    own = docs.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns)], "text")
    found = entropies(own, own.columns[:-1], model).where(_decision(model)[2])
    return found.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)])


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 4; 2 is held out."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(fold() != 2))
    return predict(docs, model).select(
        "doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
