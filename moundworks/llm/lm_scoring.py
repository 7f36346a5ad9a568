"""Scoring with an interpolated modified Kneser-Ney trigram model.

The corpus is read once per order, from the highest down; each pass needs the table of the one before it.

1. Trigrams are counted.  Tasks hash words, count the trigrams of some million tokens at a time and send each shard its
   keys and counts, packed.  A shard merges them and writes sorted hash arrays to the shared folder.
2. Bigrams get their count, the number of followers seen once, twice and more often, and the number of different words
   before them.  An occurrence whose trigram occurs c times adds 1 / c, so that every distinct trigram adds one; the sums
   are rounded once they are complete.
3. Words get their count, the number of different words before them, and the same numbers as in 2 over the bigrams that
   they begin, in the same manner.

Discounts follow from the counts of counts, a few sums.  To score, workers memory-map the arrays and look up a batch's
keys in sorted order; the model is never loaded whole or sent to anyone.  All keys are dealt by the hash of the whole
n-gram after counting within the task, so a frequent word or context costs a row per task and is never gathered.

An n-gram is known by its shard and 38 further bits of a 64-bit hash (about one in 10^5 unknown ones is taken for a known
one), a word by all 64 bits, so that counts of words are exact.  A token's probability is
(c(u, v, w) - D) / c(u, v) + g(u, v) * p2(w | v); p2 is the same over the numbers of different words before v, w, and
p1 over those before w; its rest goes evenly to the V known tokens and one unknown.  An unseen context leaves the
probability to the lower order.  Each text is words and one end token, after two begin marks that are only contexts.

Defined cases: a null text is an empty one (its one token is the end); a null id counts as '' for the fold; repeated
rows are counted and scored as often as they occur; texts of any length are taken whole; where some number of n-grams
that occur one to four times is 0, the discounts of that order are 0.5, 1 and 1.5; with no training rows every token is
unknown and has probability 1; an empty table gives no rows; columns other than doc_id, held_out and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.llm.common import free_shuffles, mix, shared_dir, slices, source_table, texts
from moundworks.llm.language_id import held_out
from moundworks.llm.repeated import by_shard, runs
from moundworks.llm.store import Store, every_shard, put
from moundworks.llm.words import hashed_words

FLUSH_TOKENS, FLUSH_WORDS = 2_000_000, 700_000
SHARD_KEYS = 3_000_000
SHARD_TOKENS = 20_000_000  # of words, each with its own row
PARTS = 64  # of a shard: six bits of a key choose one, 32 more are kept
KEY, LOW = np.uint64(38), np.uint64(32)
KEY_MASK, LOW_MASK = np.uint64((1 << 38) - 1), np.uint64((1 << 32) - 1)
PLACE, PLACE_MASK = np.uint64(26), np.uint64((1 << 26) - 1)
BEGIN, END = mix(np.array([11, 12], np.uint64))
_ODD = mix(np.arange(20, 25, dtype=np.uint64)) | np.uint64(1)


def stream(rows: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' tokens, each text after two begin marks; and the number of tokens of each text."""
    words, count = hashed_words(rows)
    out = np.full(len(words) + 3 * len(rows), BEGIN)
    out[np.arange(len(words)) + np.repeat(3 * np.arange(len(rows)) + 2, count)] = words
    out[np.cumsum(count + 3) - 1] = END
    return out, count + 1


def trigrams(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a stream's tokens and the key of the trigram that ends there."""
    at = np.flatnonzero(s != BEGIN)
    return at, mix(s[at - 2] * _ODD[0] + s[at - 1] * _ODD[1] + s[at] * _ODD[2])


def bigrams(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a bigram ends, that of two begin marks included, and its key."""
    at = 1 + np.flatnonzero((s[1:] != BEGIN) | (s[:-1] == BEGIN))
    return at, mix(s[at - 1] * _ODD[3] + s[at] * _ODD[4])


def dealt(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard and kept bits of a key in one number."""
    return ((keys >> KEY) % np.uint64(n_shards)) << KEY | (keys & KEY_MASK)


def smallest(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them."""
    whole = np.rint(values).astype(np.int64)
    return whole.astype(np.min_scalar_type(int(whole.max(initial=0))))


def batch_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in range(1, len(names)))], names=names)


def flushed(batches: Iterator[pa.RecordBatch], make: Callable[[np.ndarray], tuple], pack: Callable[..., pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """What ``pack`` makes of the arrays that ``make`` makes of streams, when they have some ``most`` rows."""
    held, n = [], 0
    for whole in batches:
        for batch in slices(whole, 0):
            held.append(make(stream(texts(batch.column(0)))[0]))
            n += len(held[-1][0])
            if n >= most:
                yield pack(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
    if n:
        yield pack(*map(np.concatenate, zip(*held, strict=True)))


def put_table(folder: str, name: str, keys: np.ndarray, once: np.ndarray, **values: np.ndarray) -> None:
    """Write a shard: sorted keys (kept bits), those that occur once apart from those with values."""
    arrays = {}
    for part, own in (("once", keys[once]), ("more", keys[~once])):
        arrays[part] = (own & LOW_MASK).astype(np.uint32)
        arrays[f"{part}_edges"] = np.searchsorted(own >> LOW, np.arange(PARTS + 1, dtype=np.uint64))
    put(folder, name, **arrays, **{k: smallest(v) for k, v in values.items()})


class Table:
    """Values of n-grams, from mapped shards."""

    def __init__(self, folder: str, name: str, n_shards: int, once: dict[str, int]) -> None:
        self.store, self.name, self.n_shards, self.once = Store(folder), name, n_shards, once

    def find(self, keys: np.ndarray) -> dict[str, np.ndarray]:
        """The named values of each key, 0 for an unknown one."""
        out = {c: np.zeros(len(keys)) for c in self.once}
        for start in range(0, len(keys), 1 << 24):
            for s, own in by_shard(((keys[start : start + (1 << 24)] >> KEY) % np.uint64(self.n_shards)).astype(np.int64), self.n_shards):
                self._shard(self.store.get(f"{self.name}-{s}"), own + start, keys, out)
        return out

    def _shard(self, have: dict[str, np.ndarray], own: np.ndarray, keys: np.ndarray, out: dict[str, np.ndarray]) -> None:
        sought = np.sort((keys[own] & KEY_MASK) << PLACE | np.arange(len(own), dtype=np.uint64))  # in order, each with its place
        own = own[(sought & PLACE_MASK).astype(np.int64)]
        sought >>= PLACE
        edges, low = np.searchsorted(sought, np.arange(PARTS + 1, dtype=np.uint64) << LOW), (sought & LOW_MASK).astype(np.uint32)
        for part in ("once", "more"):
            stored, parts = have[part], have[f"{part}_edges"].tolist()
            if not len(stored):
                continue
            at = np.empty(len(own), np.int64)
            for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                if b > a:
                    at[a:b] = np.minimum(np.searchsorted(stored[parts[k] : parts[k + 1]], low[a:b]) + parts[k], max(parts[k + 1] - 1, 0))
            inside = np.repeat(np.diff(have[f"{part}_edges"]) > 0, np.diff(edges))
            found = np.flatnonzero(inside & (stored[at] == low))
            for c, v in out.items():
                v[own[found]] = self.once[c] if part == "once" else have[c][at[found]]


TRIGRAMS = ["shard", "parts", "keys", "more_parts", "more_keys", "counts"]
T_ONCE = {"n": 1}


def pack_trigrams(n_shards: int) -> Callable[[np.ndarray], pa.RecordBatch]:
    def pack(keys: np.ndarray) -> pa.RecordBatch:
        both = np.sort(dealt(keys, n_shards))
        at, n = runs(both)
        both = both[at]
        shard, part, low = (both >> KEY).astype(np.int32), (both >> LOW & np.uint64(PARTS - 1)).astype(np.uint8), (both & LOW_MASK).astype(np.uint32)
        rows = []
        for a, size in zip(*(x.tolist() for x in runs(shard)), strict=True):
            own, more = slice(a, a + size), n[a : a + size] > 1
            rows.append((int(shard[a]), part[own][~more], low[own][~more], part[own][more], low[own][more], n[own][more].astype(np.uint32)))
        return batch_of(rows, TRIGRAMS)

    return pack


def array(rows: pd.DataFrame, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(rows[column]), kind)


def joined_keys(rows: pd.DataFrame, parts: str, keys: str) -> np.ndarray:
    return array(rows, parts, np.uint8).astype(np.uint64) << LOW | array(rows, keys, np.uint32)


def merge_trigrams(folder: str) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        packed = [joined_keys(rows, "parts", "keys") << PLACE | np.uint64(1), joined_keys(rows, "more_parts", "more_keys") << PLACE | array(rows, "counts", np.uint32)]
        packed = np.sort(np.concatenate(packed))
        at, n = runs(packed >> PLACE)
        if len(at):
            n = np.add.reduceat(packed & PLACE_MASK, at).astype(np.int64)
        once = n == 1
        put_table(folder, f"trigrams-{key[0]}", packed[at] >> PLACE, once, n=n[~once])
        return counted(n)

    return run


def counted(n: np.ndarray) -> pd.DataFrame:
    """One row: how many values are 1, 2, 3, 4 and more than 4, and their sum."""
    of = np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)[1:6]
    return pd.DataFrame([[*of.tolist(), int(n.sum())]], columns=SUMS)


SUMS = ["n1", "n2", "n3", "n4", "n5", "total"]
BIGRAMS = ["shard", "parts", "keys", "more_parts", "more_keys", "n", "k1", "k2", "k3", "before"]
VALUES = {"n": np.int64, "k1": np.int64, "k2": np.float64, "k3": np.float64, "before": np.float64}
B_ONCE = {"n": 1, "k1": 1, "k2": 0, "k3": 0, "before": 1}


def weighed(table: Table, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a stream's bigrams, with the counts of the trigrams that end with each and that begin with it (0: none)."""
    ends, keys = trigrams(s)
    c = np.zeros(len(s) + 1)
    c[ends] = table.find(keys)["n"]
    at, keys = bigrams(s)
    following = np.where(s[at] == END, 0, c[at + 1])
    return keys, c[at], following


def parts_of(n: np.ndarray) -> dict[str, np.ndarray]:
    """A share of one, for an n-gram that occurs n times, by kind: once, twice, more often."""
    share = 1 / np.maximum(n, 1)
    return {"k1": n == 1, "k2": np.where(n == 2, share, 0), "k3": np.where(n > 2, share, 0)}


def pack_bigrams(n_shards: int) -> Callable[..., pa.RecordBatch]:
    def pack(keys: np.ndarray, ending: np.ndarray, following: np.ndarray) -> pa.RecordBatch:
        both = dealt(keys, n_shards)
        order = np.argsort(both)
        both, ending, following = both[order], ending[order], following[order]
        at, n = runs(both)
        plain = (n == 1) & (ending[at] == 1) & (following[at] == 1)
        each = {"n": n, **{k: np.add.reduceat(v.astype(VALUES[k]), at) for k, v in parts_of(following).items()}, "before": np.add.reduceat(np.where(ending > 0, 1 / np.maximum(ending, 1), 0), at)}
        both = both[at]
        shard, part, low = (both >> KEY).astype(np.int32), (both >> LOW & np.uint64(PARTS - 1)).astype(np.uint8), (both & LOW_MASK).astype(np.uint32)
        rows = []
        for a, size in zip(*(x.tolist() for x in runs(shard)), strict=True):
            own, more = slice(a, a + size), ~plain[a : a + size]
            rows.append((int(shard[a]), part[own][~more], low[own][~more], part[own][more], low[own][more], *(each[k][own][more].astype(t) for k, t in VALUES.items())))
        return batch_of(rows, BIGRAMS)

    return pack


def merged(plain: np.ndarray, keys: np.ndarray, values: dict[str, np.ndarray], once: dict[str, int]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Sorted distinct keys, which of them are plain and occur once, and the sums of the values of the others.

    plain: keys, as often as they occur, each of which stands for the values ``once``.
    """
    plain = np.sort(plain)
    at, n = runs(plain)
    plain = plain[at]
    order = np.argsort(keys)
    keys, values = keys[order], {k: v[order] for k, v in values.items()}
    first = runs(keys)[0]
    full = keys[first]
    more = n > 1
    if len(full):
        place = np.minimum(np.searchsorted(full, plain), len(full) - 1)
        more |= full[place] == plain
    every = np.concatenate([plain[more], full])
    sums = {k: np.concatenate([n[more] * once[k], np.add.reduceat(v, first) if len(first) else v]) for k, v in values.items()}
    order = np.argsort(every)
    every, sums = every[order], {k: v[order] for k, v in sums.items()}
    first = runs(every)[0]
    every, sums = every[first], {k: np.add.reduceat(v, first) if len(first) else v for k, v in sums.items()}
    whole = np.concatenate([plain[~more], every])
    order = np.argsort(whole)
    return whole[order], order < (~more).sum(), sums


def merge_bigrams(folder: str) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = {k: array(rows, k, t) for k, t in VALUES.items()}
        keys, once, sums = merged(joined_keys(rows, "parts", "keys"), joined_keys(rows, "more_parts", "more_keys"), values, B_ONCE)
        put_table(folder, f"bigrams-{key[0]}", keys, once, **sums)
        return counted(np.concatenate([np.rint(sums["before"]), np.ones(once.sum())]))

    return run


WORDS = ["shard", "words", "more_words", "count", "before", "after", "k1", "k2", "k3"]
W_VALUES = {"count": np.int64, "before": np.float64, "after": np.float64, "k1": np.float64, "k2": np.float64, "k3": np.float64}
W_ONCE = {"count": 1, "before": 1, "after": 1, "k1": 1, "k2": 0, "k3": 0}


def of_words(table: Table, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """A stream's distinct words and their W_VALUES in it."""
    at, keys = bigrams(s)
    found = table.find(keys)
    ends = s[at] != BEGIN
    at, n, before = at[ends], np.maximum(found["n"][ends], 1), found["before"][ends]
    words, of = np.unique(s, return_inverse=True)
    word, context = of[at], of[at - 1]
    total = lambda x, w: np.bincount(x, w, len(words))
    kinds = (total(context, (before == 1) / n), total(context, (before == 2) / n), total(context, (before > 2) / n))
    return words, np.bincount(word, minlength=len(words)), total(word, 1 / n), total(context, before / n), *kinds


def pack_words(n_shards: int) -> Callable[..., pa.RecordBatch]:
    def pack(words: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(words)
        at = runs(words[order])[0]
        words, values = words[order][at], [np.add.reduceat(v[order], at) for v in values]
        plain = np.logical_and.reduce([v == W_ONCE[k] for k, v in zip(W_VALUES, values, strict=True)])
        rows = [(s, words[own][plain[own]], words[own][~plain[own]], *(v[own][~plain[own]].astype(t) for v, t in zip(values, W_VALUES.values(), strict=True))) for s, own in by_shard((words % np.uint64(n_shards)).astype(np.int64), n_shards)]
        return batch_of(rows, WORDS)

    return pack


def merge_words(folder: str) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = {k: array(rows, k, t) for k, t in W_VALUES.items()}
        words, once, sums = merged(array(rows, "words", np.uint64), array(rows, "more_words", np.uint64), values, W_ONCE)
        put(folder, f"words-{key[0]}", once=words[once], more=words[~once], **{k: smallest(v) for k, v in sums.items()})
        known = sums["count"] > 0  # the begin mark is only a context
        return counted(np.concatenate([np.rint(sums["before"][known]), np.ones(once.sum())])).assign(tokens=int(sums["count"].sum() + once.sum()), words=int(known.sum() + once.sum()))

    return run


class Words:
    """Values of words, from mapped shards."""

    def __init__(self, folder: str, n_shards: int) -> None:
        self.store, self.n_shards = Store(folder), n_shards

    def find(self, words: np.ndarray) -> dict[str, np.ndarray]:
        """W_VALUES of sorted distinct words, 0 for an unknown one."""
        out = {c: np.zeros(len(words)) for c in W_VALUES}
        for s, own in by_shard((words % np.uint64(self.n_shards)).astype(np.int64), self.n_shards):
            have = self.store.get(f"words-{s}")
            for part in ("once", "more"):
                if len(have[part]):
                    at = np.minimum(np.searchsorted(have[part], words[own]), len(have[part]) - 1)
                    found = have[part][at] == words[own]
                    for c, v in out.items():
                        v[own[found]] = W_ONCE[c] if part == "once" else have[c][at[found]]
        return out


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from the numbers of n-grams that occur 1 to 4 times."""
    if min(n) == 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([0.0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], [0, 0, 0, 0], [0, 1, 2, 3])


@dataclass(frozen=True)
class Model:
    folder: str
    n_shards: int  # of trigrams and of bigrams
    word_shards: int
    d3: np.ndarray
    d2: np.ndarray
    d1: np.ndarray
    rest: float  # share of p1 that is spread evenly
    n_bigrams: int  # distinct ones
    n_tokens: int
    n_words: int


def train(docs: DataFrame) -> Model:
    """Count docs (column text) and write the model's arrays."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "lm")
    text = docs.select("text")
    tokens = (text.agg(F.sum(F.length("text"))).first()[0] or 0) / 6
    n_shards, word_shards = int(tokens // SHARD_KEYS) + 4, int(tokens // SHARD_TOKENS) + 4

    def counts(make: Callable[[], Callable], pack: Callable, names: list[str], shards: int, merge: Callable, sums: list[str]) -> list[int]:
        """Run a pass; the sums of its statistics."""
        run = lambda batches: flushed(batches, make(), pack, FLUSH_WORDS if names is WORDS else FLUSH_TOKENS)
        packed = text.mapInArrow(run, ", ".join(["shard int", *(f"{c} binary" for c in names[1:])]))
        done = every_shard(packed, shards).groupBy("shard").applyInPandas(merge, ", ".join(f"{c} long" for c in sums))
        found = [int(x or 0) for x in done.agg(*[F.sum(c) for c in sums]).first()]
        free_shuffles(spark)
        return found

    def over(name: str, once: dict[str, int], f: Callable) -> Callable[[], Callable]:
        def make() -> Callable:
            table = Table(folder, name, n_shards, once)
            return lambda s: f(table, s)

        return make

    three = counts(lambda: lambda s: trigrams(s)[1:], pack_trigrams(n_shards), TRIGRAMS, n_shards, merge_trigrams(folder), SUMS)
    two = counts(over("trigrams", T_ONCE, weighed), pack_bigrams(n_shards), BIGRAMS, n_shards, merge_bigrams(folder), SUMS)
    one = counts(over("bigrams", B_ONCE, of_words), pack_words(word_shards), WORDS, word_shards, merge_words(folder), [*SUMS, "tokens", "words"])
    d1, n_bigrams = discounts(one[:4]), one[5]
    rest = float((d1[1] * one[0] + d1[2] * one[1] + d1[3] * sum(one[2:5])) / n_bigrams) if n_bigrams else 1.0
    return Model(folder, n_shards, word_shards, discounts(three[:4]), discounts(two[:4]), d1, rest, n_bigrams, one[6], one[7])


class Lookup:
    """A model's tables."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.trigrams, self.bigrams = Table(model.folder, "trigrams", model.n_shards, T_ONCE), Table(model.folder, "bigrams", model.n_shards, B_ONCE)
        self.words = Words(model.folder, model.word_shards)

    def probabilities(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token of a stream: its probability under the model, and its count in training."""
        m = self.model
        less = lambda n, d: np.maximum(n - d[np.minimum(n, 3).astype(np.int64)], 0)
        words, of = np.unique(s, return_inverse=True)
        known = self.words.find(words)
        at, keys = trigrams(s)
        word, context = of[at], of[at - 1]
        p = (less(known["before"], m.d1) / max(m.n_bigrams, 1) + m.rest / (m.n_words + 1))[word]
        places, pairs = bigrams(s)
        pair = {c: np.zeros(len(s)) for c in B_ONCE}
        for c, v in self.bigrams.find(pairs).items():
            pair[c][places] = v
        total, back = known["after"], m.d2[1] * known["k1"] + m.d2[2] * known["k2"] + m.d2[3] * known["k3"]
        seen = total[context] > 0
        p = np.where(seen, (less(pair["before"][at], m.d2) + back[context] * p) / np.maximum(total[context], 1), p)
        total, back = pair["n"][at - 1], m.d3[1] * pair["k1"][at - 1] + m.d3[2] * pair["k2"][at - 1] + m.d3[3] * pair["k3"][at - 1]
        count = self.trigrams.find(keys)["n"]
        return np.where(total > 0, (less(count, m.d3) + back * p) / np.maximum(total, 1), p), known["count"][word]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(model)
        for whole in batches:
            for batch in slices(whole, 2, 4 << 20):
                s, size = stream(texts(batch.column(2)))
                p, c = look.probabilities(s)
                doc = np.repeat(np.arange(len(size)), size)
                total = lambda x: np.bincount(doc, x, len(size))  # noqa: B023, E731
                base = np.log10((c + 1) / (model.n_tokens + model.n_words + 1))
                lm = total(np.log10(p))
                with np.errstate(over="ignore"):
                    cols = [pa.array(size), pa.array(total(c > 0).astype(np.int64)), pa.array(np.full(len(size), model.n_tokens, np.int64)), pa.array(total(base)), pa.array(lm), pa.array(10 ** (-lm / size))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(7))
    return score(docs, train(docs.where(~F.col("held_out"))))
