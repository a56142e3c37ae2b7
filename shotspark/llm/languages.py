"""Language of text records by character models with interpolated Kneser-Ney smoothing."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotspark.llm.texts import small_batches
from shotspark.session import durable

#: Letters, and the few signs that Python counts among word characters besides digits.
WORD = re.compile(r"[^\W\d_]+")
#: The answer for records without a letter.
UNKNOWN = "und"
#: Predicted characters per piece of a long word.
PIECE = 64
#: Odd multipliers of the window hash, by distance from the window's last character.
RANDOM = np.random.default_rng(11).integers(1 << 62, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# ---------------------------------------------------------------- words and windows


def words_of(text: str) -> list[str]:
    """Lower-case runs of word characters other than digits."""
    return WORD.findall(text.lower())


def pieces_of(word: str, order: int) -> list[str]:
    """A word between blanks in pieces that predict each of its characters, and the end, once.

    Every piece starts with the ``order - 1`` characters before its first predicted one.
    Signs that are no letters divide words; without a letter there is no piece.
    """
    parts = [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split()
    out = []
    for part in parts:
        padded = " " * (order - 1) + part + " "
        out += [padded[k : k + PIECE + order - 1] for k in range(0, len(part) + 1, PIECE)]
    return out


def slots(hashed: np.ndarray, bits: int) -> np.ndarray:
    mixed = (hashed ^ (hashed >> np.uint64(29))) * RANDOM[31]
    return (mixed >> np.uint64(64 - bits)).astype(np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def window_slots(windows: list[str], bits: int) -> np.ndarray:
    """Slots of whole strings, equal to those of windows that end in a longer text."""
    size = np.fromiter(map(len, windows), np.int64, len(windows))
    points = code_points("".join(windows))
    back = np.repeat(np.cumsum(size), size) - 1 - np.arange(len(points))
    total = np.concatenate([[np.uint64(0)], np.cumsum(points * RANDOM[back])])
    ends = np.cumsum(size)
    return slots(total[ends] - total[ends - size], bits)


# ---------------------------------------------------------------- the models


@dataclass(frozen=True)
class Level:
    """Windows of one length: sorted slots, and for each slot a row of values per model.

    ``seen`` is the discounted probability of a window's last character, ``passed`` the weight that the
    window, as a context, leaves to the shorter one.  The first row is for other windows.
    """

    keys: np.ndarray
    seen: np.ndarray
    passed: np.ndarray

    def rows(self, wanted: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at + 1, 0)


@dataclass(frozen=True)
class Models:
    """Character models as sorted hash arrays per window length.

    There is a model per language; with folds, ``copies`` times as many, copy after copy.
    """

    languages: tuple[str, ...]
    copies: int
    #: Shares of a character nothing is known about, and what no context leaves to them.
    uniform: np.ndarray
    passed: np.ndarray
    levels: tuple[Level, ...]
    bits: int
    #: What was found for earlier words, which a worker keeps from batch to batch.
    kept: dict[str, int] = field(default_factory=dict)
    found: list[np.ndarray] = field(default_factory=list)

    def of_words(self, words: list[str], limit: int = 200_000) -> np.ndarray:
        """Rows of bits under every model, predicted characters and letters; ``limit`` words are kept."""
        at = np.fromiter((self.kept.get(w, -1) for w in words), np.int64, len(words))
        out = np.empty((len(words), len(self.uniform) + 2), np.float32)
        new = np.flatnonzero(at < 0)
        fresh = [words[i] for i in new]
        cost, *sizes = self.surprise(fresh)
        out[new] = np.column_stack([cost, *sizes])
        if not self.found:
            self.found.append(np.empty((limit, out.shape[1]), np.float32))
        out[at >= 0] = self.found[0][at[at >= 0]]
        room = max(0, limit - len(self.kept))
        self.found[0][len(self.kept) : len(self.kept) + len(fresh[:room])] = out[new[:room]]
        self.kept.update(zip(fresh[:room], range(len(self.kept), len(self.kept) + room), strict=False))
        return out

    def surprise(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word its bits under every model, predicted characters, and letters."""
        order = len(self.levels)
        cut = [pieces_of(w, order) for w in words]
        of_word = np.repeat(np.arange(len(words)), np.fromiter(map(len, cut), np.int64, len(words)))
        flat = [p for own in cut for p in own]
        size = np.fromiter(map(len, flat), np.int64, len(flat))
        points = code_points("".join(flat))
        first = np.cumsum(size) - size
        at = np.flatnonzero(np.arange(len(points)) - np.repeat(first, size) >= order - 1)
        owner = np.repeat(of_word, size)[at]
        chance = np.broadcast_to(self.uniform * self.passed, (len(at), len(self.uniform)))
        window = np.zeros(len(points), np.uint64)
        for n, level in enumerate(self.levels):
            moved = np.zeros(len(points), np.uint64)
            moved[n:] = points[: len(points) - n]
            window = window + moved * RANDOM[n]
            rows = level.rows(slots(window, self.bits))
            chance = level.seen[rows[at]] + chance
            if n + 1 < order:
                # A window that ends before a character is the context of the next longer one.
                chance = chance * level.passed[rows[at - 1]]
        cost = -np.log2(chance)
        total = np.empty((len(words), len(self.uniform)))
        for k in range(len(self.uniform)):
            total[:, k] = np.bincount(owner, cost[:, k], len(words))
        letters = np.bincount(owner[points[at] != ord(" ")], minlength=len(words))
        return total, np.bincount(owner, minlength=len(words)), letters


def _pieces(records: DataFrame, order: int, held: int = 300_000) -> DataFrame:
    """``lang, fold, piece, n`` of all words, counted together within a task."""

    def rows(counts: dict[tuple[str, int], Counter]) -> pa.RecordBatch:
        own = [
            (*part, piece, n) for part, c in counts.items() for word, n in c.items() for piece in pieces_of(word, order)
        ]
        names, kinds = ["lang", "fold", "piece", "n"], [pa.string(), pa.int32(), pa.string(), pa.int64()]
        columns = list(zip(*own, strict=True)) or [[]] * 4
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], Counter] = {}
        for batch in small_batches(batches, "text"):
            for lang, fold, body in zip(*(batch[c].to_pylist() for c in ("lang", "fold", "text")), strict=True):
                counts.setdefault((lang, fold), Counter()).update(words_of(body))
            if sum(map(len, counts.values())) > held:
                yield rows(counts)
                counts = {}
        yield rows(counts)

    known = records.where("text is not null and lang is not null").select("lang", "fold", "text")
    return known.mapInArrow(count, "lang string, fold int, piece string, n bigint")


def fit_languages(
    records: DataFrame, text: str = "payload", language: str = "lang", order: int = 4, bits: int = 22, folds: int = 1
) -> Models:
    """Kneser-Ney models of all texts in ``records``, one per value of ``language``.

    The highest order counts windows of ``order`` characters inside padded words; every lower
    order counts in how many different windows of the next one it ends.  From each count the
    discount n1 / (n1 + 2 n2) of its order is taken and given to the lower order, the lowest
    to all characters alike.  All rows are counted; rows with a null text or language are not.
    With two or more ``folds`` further copies of all models follow, of which number 1 + f leaves out
    the texts whose :func:`fold_of` is f.

    Counting is distributed.  The models are sent to the executors, and their size is bounded
    whatever the input: windows share ``2 ** bits`` slots an order (the commonest window of a
    slot and model gives the value), so there are at most ``order * 2 ** bits`` slots of 4 bytes
    and 8 for every language and copy.
    """
    rows = records.select(F.col(text).cast("string").alias("text"), F.col(language).cast("string").alias("lang"))
    rows = rows.withColumn("fold", fold_of(F.col("text"), folds))
    piece = F.col("piece")
    begins = F.sequence(F.lit(1), F.char_length(piece) - (order - 1))
    windows = F.transform(begins, lambda i: F.substr(piece, i, F.lit(order)))
    counted = _pieces(rows, order).select("lang", "fold", "n", F.explode(windows).alias("gram"))
    counted = counted.groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n"))
    others = [F.when(F.col("fold") != f, f + 1) for f in range(folds if folds > 1 else 0)]
    model = F.explode(F.array_compact(F.array(F.lit(0), *others)))
    level = durable(counted.select("lang", model.alias("model"), "gram", "n").groupBy("model", "lang", "gram").agg(F.sum("n").alias("c")))
    entries, letters = None, None
    of = ["model", "lang"]
    for n in range(order, 0, -1):
        ones, twos = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
        rate = F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(F.lit(0.5))
        discount = level.groupBy(*of).agg(rate.alias("d"))
        context = F.substr("gram", F.lit(1), F.lit(n - 1))
        contexts = level.groupBy(*of, context.alias("context")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
        contexts = contexts.join(discount, of)
        seen = level.withColumn("context", context).join(contexts, [*of, "context"]).select(
            *of, F.lit(n).alias("n"), F.lit(False).alias("is_context"), F.col("gram").alias("window"),
            ((F.col("c") - F.col("d")) / F.col("total")).alias("value"), F.col("c").alias("weight"),
        )
        passed = contexts.select(
            *of, F.lit(n).alias("n"), F.lit(True).alias("is_context"), F.col("context").alias("window"),
            (F.col("d") * F.col("kinds") / F.col("total")).alias("value"), F.col("total").alias("weight"),
        )
        entries = seen.unionByName(passed) if entries is None else entries.unionByName(seen).unionByName(passed)
        if n > 1:
            ending = F.substr("gram", F.lit(2), F.lit(n - 1))
            level = durable(level.groupBy(*of, ending.alias("gram")).agg(F.count(F.lit(1)).alias("c")))
        else:
            letters = level.groupBy(*of).count()
    carried = [*of, "n", "is_context", "value", "weight"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = window_slots(batch["window"].to_pylist(), bits).astype(np.int64)
            yield pa.record_batch([*(batch[c] for c in carried), pa.array(slot)], names=[*carried, "slot"])

    placed = entries.mapInArrow(
        place, "model int, lang string, n int, is_context boolean, value double, weight bigint, slot bigint"
    )
    table = placed.groupBy(*of, "n", "is_context", "slot").agg(F.max_by(F.col("value").cast("float"), "weight").alias("value")).toArrow()
    sizes = {(r["model"], r["lang"]): r["count"] for r in letters.collect()}
    languages = tuple(sorted({lang for _, lang in sizes}))
    copies = 1 + len(others)
    number = {lang: k for k, lang in enumerate(languages)}
    column = table["model"].to_numpy() * len(languages) + np.array([number[x] for x in table["lang"].to_pylist()], np.int64)
    is_context = table["is_context"].to_numpy().astype(bool)
    length = table["n"].to_numpy() - is_context
    slot, value = table["slot"].to_numpy().astype(np.uint32), table["value"].to_numpy()
    width = copies * len(languages)
    passed = np.ones(width, np.float32)
    passed[column[length == 0]] = value[length == 0]
    levels = []
    for n in range(1, order + 1):
        keys, sides = np.unique(slot[length == n]), []
        for context, default in ((False, 0.0), (True, 1.0)):
            own = (length == n) & (is_context == context)
            values = np.full((len(keys) + 1 if not context or n < order else 0, width), default, np.float32)
            values[np.searchsorted(keys, slot[own]) + 1, column[own]] = value[own]
            sides.append(values)
        levels.append(Level(keys, *sides))
    uniform = np.array([1.0 / (sizes.get((m, x), 0) + 1) for m in range(copies) for x in languages], np.float32)
    return Models(languages, copies, uniform, passed, tuple(levels), bits)


def fold_of(text: Column, folds: int) -> Column:
    """Copies of a text share a fold."""
    return F.pmod(F.xxhash64(text), F.lit(folds)).cast("int")


# ---------------------------------------------------------------- answers


def _steepness(entropies: np.ndarray, letters: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """``(a, b)`` that make softmax of ``-a * letters ** b * entropy`` most likely on known rows."""
    best = (np.inf, 1.0, 0.0)
    gap = entropies - entropies.min(axis=1, keepdims=True)
    rows = np.arange(len(truth))
    for b in (0.0, 0.25, 0.5, 0.75, 1.0):
        for a in 2.0 ** np.arange(-6, 8):
            scaled = a * (letters**b)[:, None] * gap
            # A smoothed loss: no row may claim more than a thousand to one against its label.
            loss = np.minimum(scaled[rows, truth] + np.log(np.exp(-scaled).sum(axis=1)), 7.0).mean()
            if loss < best[0] - 1e-12:
                best = (loss, float(a), b)
    return best[1:]


def identify_languages(
    records: DataFrame, key: str = "source_event_id", text: str = "payload", language: str = "lang",
    learn: Column | None = None, order: int = 4, bits: int = 22, accept: float = 0.999, sample_rows: int = 20_000,
) -> DataFrame:
    """``key, lang_pred, score, cross_entropy, n_letters, rejected`` of every record.

    The library's records with free text are rejected messages (``source_event_id``,
    ``payload``); any other key and text column can be named.  Rows for which ``learn`` holds
    (all by default) and whose ``language`` is not null teach; for no other row is the
    language read.  :func:`fit_languages` counts all of them.

    ``lang_pred`` is the language with the lowest cross-entropy in bits a character, the
    smaller name among equals; ``und`` where the text is null or has no letter, or where
    nothing was learnt.

    Teaching rows are also measured by models that have not counted them nor any copy of their text, each half by
    those of the other.  From these entropies come the ``score``, the softmax of the
    negative entropies, whose steepness is fitted on at most ``sample_rows`` rows (smallest
    hashes; 0 for ``und``), and ``rejected``, which marks texts unlike their own language:
    how far a text's entropy lies above the language's mean, times the root of its length,
    exceeds the ``accept`` quantile, mean and quantile over all teaching rows of the language.

    Every text is read whole.  Null and repeated keys stay rows of their own, empty tables
    give empty results, and further columns are ignored.
    """
    spark = records.sparkSession
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    rows = records.select(
        F.col(key).alias("key"), F.col(text).cast("string").alias("text"),
        F.when(learn, F.col(language).cast("string")).alias("lang"),
    )
    models = fit_languages(rows, "text", "lang", order, bits, folds=2)
    names = models.languages
    sent = spark.sparkContext.broadcast(models)
    kind = records.schema[key].dataType.simpleString()
    folded = rows.withColumn("fold", F.when(F.col("lang").isNotNull(), fold_of(F.col("text"), 2)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in small_batches(batches, "text", 1 << 20):
            found = [words_of(t) if t else [] for t in batch["text"].to_pylist()]
            edges = np.cumsum([0, *map(len, found)])
            number = pa.array([w for f in found for w in f], pa.large_string()).dictionary_encode()
            words, code = number.dictionary.to_pylist(), number.indices.to_numpy()

            each = known.of_words(words).astype(np.float64)[code]
            total = np.zeros((len(found), each.shape[1]))
            full = np.flatnonzero(np.diff(edges))
            if len(full):
                total[full] = np.add.reduceat(each, edges[full])
            size = np.rint(total[:, -2:]).astype(np.int64)
            entropies = (total[:, :-2] / np.maximum(size[:, :1], 1)).reshape(len(found), known.copies, -1)
            fold = np.array([0 if f is None else 1 + f for f in batch["fold"].to_pylist()], np.int64)
            apart = entropies[np.arange(len(found)), fold]
            ends = pa.array(np.arange(len(found) + 1) * len(names), pa.int32())
            yield pa.record_batch(
                [batch["key"], batch["lang"], pa.array(size[:, 1]), pa.array(size[:, 0]),
                 *(pa.ListArray.from_arrays(ends, pa.array(e.ravel())) for e in (entropies[:, 0], apart))],
                names=["key", "lang", "n_letters", "n_predicted", "entropies", "apart"],
            )

    scored = durable(
        folded.mapInArrow(
            measure,
            f"key {kind}, lang string, n_letters bigint, n_predicted bigint, entropies array<double>, apart array<double>",
        )
    )
    none = F.lit(None)
    if not names:
        return scored.select(
            F.col("key").alias(key), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
            none.cast("double").alias("cross_entropy"), "n_letters", F.lit(False).alias("rejected"),
        )
    taught = scored.where("lang is not null and n_letters > 0").withColumn(
        "own", F.element_at("apart", F.array_position(F.array(*map(F.lit, names)), F.col("lang")).cast("int"))
    )
    sample = taught.orderBy(F.xxhash64("key", "apart", "lang"), "lang").limit(sample_rows).select("apart", "n_letters", "lang").collect()
    a, b = (1.0, 0.0)
    if sample:
        truth = np.array([names.index(r.lang) for r in sample])
        a, b = _steepness(np.array([r.apart for r in sample]), np.array([float(r.n_letters) for r in sample]), truth)
    # One row per language each; no teaching row moves.
    bits_of = F.sum(F.col("own") * F.col("n_predicted")) / F.sum("n_predicted")
    means = {r[0]: r[1] for r in taught.groupBy("lang").agg(bits_of).collect()}
    means = [means.get(x, 0.0) for x in names]
    number = F.array_position(F.array(*map(F.lit, names)), F.col("lang")).cast("int")
    excess = (F.col("own") - F.element_at(F.array(*map(F.lit, means)), number)) * F.sqrt("n_predicted")
    tops = {r[0]: r[1] for r in taught.groupBy("lang").agg(F.percentile_approx(excess, accept, 10_000)).collect()}
    tops = [tops.get(x, 0.0) for x in names]
    lowest = F.array_min("entropies")
    place = F.array_position("entropies", lowest).cast("int")
    has = F.col("n_letters") > 0
    of_place = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), place)
    steep = F.lit(a) * F.pow(F.col("n_letters").cast("double"), F.lit(b))
    spread = F.aggregate("entropies", F.lit(0.0), lambda s, e: s + F.exp(-steep * (e - lowest)))
    far = (lowest - of_place(means)) * F.sqrt("n_predicted") > of_place(tops)
    return scored.select(
        F.col("key").alias(key),
        F.when(has, of_place(names)).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(has, 1.0 / spread).otherwise(F.lit(0.0)).alias("score"),
        F.when(has, lowest).alias("cross_entropy"),
        "n_letters",
        (has & far).alias("rejected"),
    )
