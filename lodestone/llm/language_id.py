"""Language identification with interpolated Kneser-Ney character models.

Text becomes a sequence of lower-case letters with one mark between words; every model is of order four over that
sequence. Counts come from all training documents: each task counts its own four-grams, Spark sums them, and the
four-grams per language - not documents - reach the driver, all of them: discounts, continuation counts of the lower
orders and the rejection levels need the rare ones. The model is broadcast whole. N-grams are kept in sorted arrays
of their 64-bit hashes (an odd multiplication, so no two collide).

The prediction is the language of the lowest cross-entropy per character. A document is rejected when that
cross-entropy lies too far from the language's own level towards that of random letters, with room for the variance of
short texts. How far is too far is calibrated: a fifth of the training documents is kept out of a first fit, their
cross-entropies under it give the share of the way that own texts go (its ``OWN`` quantile), and the limit lies half way
between that share and random letters. The final models then learn from all training documents. The score is the
posterior probability of the language among the learned ones, all equally likely before, as if the text had at most
``EVIDENCE`` characters: cross-entropies of long texts are not independent evidence, and the score would always be 1.

Letters beyond the basic plane take part as one of 2048 stand-ins each (their code point's remainder).

Null text and text without a letter is ``und`` and rejected; a null doc_id counts as held out; a document without
lang is not learned from; repeated rows and other columns do not matter; without training rows all is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bound_batches, map_batches, slices, spread, tidy

ORDER = 4
UNKNOWN = "und"
#: A task hands on its counts when it holds so many four-grams.
FLUSH_AT = 1 << 21
#: Characters that are worked on at once (a longer text counts as one).
AT_ONCE = 1 << 20
#: Probability of a letter that no training text has.
UNSEEN = 1 / 4096
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Rejection: the quantile of own texts that calibrates a limit, a limit without such texts (as a share of the way from a
#: language's own cross-entropy to that of random letters), and the room for short texts in standard errors.
OWN, REJECT_AT, REJECT_SPREAD = 0.999, 0.6, 4.0
#: Characters that the score counts at most.
EVIDENCE = 50
BEYOND = re.compile("[\U00010000-\U0010ffff]")


def stand_in(m: re.Match[str]) -> str:
    """A letter beyond the basic plane as a surrogate, which no text holds alone; anything else as a blank."""
    letter = m[0].lower()
    return chr(0xD800 + ord(letter[0]) % 2048) if m[0].isalpha() else " "


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Lower-case letter of each UTF-16 unit, stand-ins included; 0 for what is no letter."""
    table = np.zeros(1 << 16, np.uint16)
    for u in range(1 << 16):
        if 0xD800 <= u < 0xE000:
            table[u] = u
        elif chr(u).isalpha():
            low = chr(u).lower()
            table[u] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else u
    return table


def four_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed four-grams of all texts (each starts afresh) and the number of each text's."""
    parts = [b"\0\0" + (t or "").encode("utf-16-le", "surrogatepass") for t in texts]
    for i, text in enumerate(texts):
        if text and len(parts[i]) != 2 * len(text) + 2:
            parts[i] = b"\0\0" + BEYOND.sub(stand_in, text).encode("utf-16-le", "surrogatepass")
    units = letter_table()[np.frombuffer(b"".join(parts), "<u2")]
    sizes = np.array([len(p) // 2 for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    keep = units != 0
    keep[1:] |= units[:-1] != 0  # one mark after each word
    keep[starts] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    counts = kept[starts + sizes] - kept[starts]
    v = units[keep].astype(np.uint64)
    begin = np.repeat(np.cumsum(counts) - counts, counts)
    offset = np.arange(len(v)) - begin
    keys = v.copy()
    for back in range(1, ORDER):
        prior = np.zeros_like(v)
        prior[back:] = v[:-back] if len(v) > back else 0
        prior[offset < back] = 0
        keys |= prior << np.uint64(16 * back)
    return keys, counts


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(keys) else weights


class HashArray:
    """Values by n-gram in a sorted array of hashes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = keys * MIX
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]

    def get(self, keys: np.ndarray, missing: float) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(keys), missing)
        hashes = keys * MIX
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.values[at], missing)


@dataclass
class KneserNey:
    """One language's model: discounted weights per n-gram and interpolation weights per context."""

    unigram: np.ndarray
    grams: dict[int, HashArray] = field(default_factory=dict)
    contexts: dict[int, HashArray] = field(default_factory=dict)
    mean: float = 0.0
    spread: float = 0.0
    alien: float = 0.0
    reject_at: float = REJECT_AT

    @classmethod
    def fit(cls, keys: np.ndarray, counts: np.ndarray) -> KneserNey:
        model = cls(np.full(1 << 16, UNSEEN))
        level = {ORDER: (keys, counts.astype(np.float64))}
        for n in range(ORDER - 1, 0, -1):  # continuation counts: in how many ways the n-gram extends to the left
            suffix = level[n + 1][0] & np.uint64((1 << (16 * n)) - 1)
            k, c = counted(suffix)
            level[n] = (k, c.astype(np.float64))
        for n in range(1, ORDER + 1):
            k, c = level[n]
            once, twice = float((c == 1).sum()), float((c == 2).sum())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            context = k >> np.uint64(16)
            ctx, inverse = np.unique(context, return_inverse=True)
            total = np.bincount(inverse, c, len(ctx))
            kinds = np.bincount(inverse, minlength=len(ctx))
            weight = (c - discount) / total[inverse]
            share = discount * kinds / total
            if n == 1:
                if len(k):
                    model.unigram *= share[0]
                    model.unigram[k.astype(np.int64)] += weight
            else:
                model.grams[n], model.contexts[n] = HashArray(k, weight), HashArray(ctx, share)
        bits = -np.log2(model.probability(keys))
        share = counts / counts.sum()
        model.mean = float((bits * share).sum())
        model.spread = float(np.sqrt(((bits - model.mean) ** 2 * share).sum()))
        letters = np.unique(keys & np.uint64(0xFFFF))
        draw = np.random.default_rng(7).integers(0, len(letters), (20_000, ORDER))
        packed = np.zeros(len(draw), np.uint64)
        for i in range(ORDER):
            packed |= letters[draw[:, i]] << np.uint64(16 * i)
        model.alien = float(-np.log2(model.probability(packed)).mean())
        return model

    def probability(self, keys: np.ndarray) -> np.ndarray:
        p = self.unigram[(keys & np.uint64(0xFFFF)).astype(np.int64)]
        for n in range(2, ORDER + 1):
            gram = keys & np.uint64((1 << (16 * n)) - 1) if n < 4 else keys
            p = self.grams[n].get(gram, 0.0) + self.contexts[n].get(gram >> np.uint64(16), 1.0) * p
        return p


@dataclass
class LanguageModels:
    languages: list[str]
    models: list[KneserNey]

    def classify(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, bits per character, rejected) of each text."""
        keys, counts = four_grams(texts)
        out: list[tuple[str, float, float | None, bool]] = []
        if self.models and len(keys):
            distinct = np.unique(keys)
            place = positions(distinct, keys)
            edges = np.concatenate([[0], np.cumsum(counts)])
            sums = np.empty((len(texts), len(self.models)))
            for j, model in enumerate(self.models):
                bits = -np.log2(model.probability(distinct))
                run = np.concatenate([[0.0], np.cumsum(bits[place])])
                sums[:, j] = run[edges[1:]] - run[edges[:-1]]
        for i in range(len(texts)):
            n = int(counts[i])
            if not self.models or n == 0:
                out.append((UNKNOWN, 0.0, None, True))
                continue
            entropy = sums[i] / n
            best = int(np.argmin(np.round(entropy, 9)))
            odds = np.exp2(np.clip((entropy[best] - entropy) * min(n, EVIDENCE), -60, 0))
            m = self.models[best]
            limit = m.mean + max(m.reject_at * (m.alien - m.mean), 0.5) + REJECT_SPREAD * m.spread / np.sqrt(n)
            out.append((self.languages[best], float(1 / odds.sum()), float(entropy[best]), bool(entropy[best] > limit)))
        return out


def positions(distinct: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted ``distinct``: by a hash slot, by binary search where slots clash."""
    slot_of = (distinct * MIX >> np.uint64(44)).astype(np.int64)
    slots = np.zeros(1 << 20, np.int32)
    slots[slot_of] = np.arange(len(distinct), dtype=np.int32)
    at = slots[(keys * MIX >> np.uint64(44)).astype(np.int64)]
    wrong = np.flatnonzero(distinct[at] != keys)
    at[wrong] = np.searchsorted(distinct, keys[wrong])
    return at


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def kept_out() -> Column:
    """The training rows that calibrate the rejection."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1


def four_gram_counts(training: DataFrame) -> DataFrame:
    """(lang, gram long, n long, kept_out long: of n) over all rows of ``training`` (lang, kept_out, text)."""
    bound_batches(training.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bool], tuple[np.ndarray, np.ndarray]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, out), (keys, n) in held.items():
                counts = pa.array(n.astype(np.int64))
                apart = counts if out else pa.array(np.zeros(len(n), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), counts, apart], names=["lang", "gram", "n", "kept_out"])
            held.clear()

        for batch in batches:
            kinds = list(zip(batch.column("lang").to_pylist(), batch.column("kept_out").to_pylist()))
            texts = batch.column("text").to_pylist()
            for kind in sorted(set(kinds)):
                mine = [t for t, k in zip(texts, kinds) if k == kind]
                for part in slices(mine, AT_ONCE):
                    keys, n = counted(four_grams(mine[part])[0])
                    if kind in held:
                        keys, n = counted(np.concatenate([held[kind][0], keys]), np.concatenate([held[kind][1], n]))
                    held[kind] = (keys, n)
            if sum(len(k) for k, _ in held.values()) > FLUSH_AT:
                yield from rows()
        yield from rows()
        tidy()

    counts = spread(training).mapInArrow(run, "lang string, gram long, n long, kept_out long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("kept_out").alias("kept_out"))


def own_shares(docs: DataFrame, models: LanguageModels) -> dict[str, float]:
    """Per language the share of the way to random letters that its own texts (lang, text) go, room for short ones aside."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        out = []
        for part in slices(texts, AT_ONCE):
            keys, counts = four_grams(texts[part])
            edges = np.concatenate([[0], np.cumsum(counts)])
            for lang in set(langs[part]) & set(shared.value.languages):
                m = shared.value.models[shared.value.languages.index(lang)]
                for i in (i for i, own in enumerate(langs[part]) if own == lang and counts[i]):
                    bits = -np.log2(m.probability(keys[edges[i] : edges[i + 1]])).mean()
                    out.append((lang, (bits - REJECT_SPREAD * m.spread / np.sqrt(counts[i]) - m.mean) / max(m.alien - m.mean, 1e-9)))
        lang, share = zip(*out) if out else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(share, pa.float64())], names=["lang", "share"])

    shares = map_batches(docs, one, "lang string, share double").groupBy("lang").agg(F.percentile_approx("share", OWN, 10_000).alias("share"))
    return {r["lang"]: r["share"] for r in shares.collect()}


def fit(docs: DataFrame) -> LanguageModels:
    """Models of all languages that the training fold names."""
    named = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    training = named.select(F.col("lang").cast("string").alias("lang"), kept_out().alias("kept_out"), F.col("text").cast("string").alias("text"))
    table = four_gram_counts(training).toArrow()
    codes = table.column("lang").dictionary_encode().combine_chunks()
    names, lang = codes.dictionary.to_pylist(), codes.indices.to_numpy()
    gram = table.column("gram").to_numpy().view(np.uint64)
    n, apart = table.column("n").to_numpy(), table.column("kept_out").to_numpy()

    def models_of(counts: np.ndarray) -> LanguageModels:
        found = LanguageModels([], [])
        for one in sorted(names):
            mine = np.flatnonzero((lang == names.index(one)) & (counts > 0))
            order = mine[np.argsort(gram[mine])]
            if len(order):
                found.languages.append(one)
                found.models.append(KneserNey.fit(gram[order], counts[order]))
        return found

    final = models_of(n)
    shares = own_shares(training.where("kept_out").select("lang", "text"), models_of(n - apart))
    for one, model in zip(final.languages, final.models):
        if one in shares:
            model.reject_at = (min(max(shares[one], 0.0), 1.0) + 1) / 2
    return final


def identify(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, rejected) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        found = [r for part in slices(texts, AT_ONCE) for r in shared.value.classify(texts[part])]
        lang, score, entropy, rejected = zip(*found) if found else ([], [], [], [])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())],
            names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"],
        )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_batches(spread(source), one, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def predict_languages(docs: DataFrame) -> DataFrame:
    return identify(docs, fit(docs))


def keep_known_language(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised."""
    models = docs.sparkSession.sparkContext.broadcast(fit(docs))
    names = docs.columns

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        keep = [not r[3] for part in slices(texts, AT_ONCE) for r in models.value.classify(texts[part])]
        kept = batch.filter(pa.array(keep, pa.bool_()))
        return pa.RecordBatch.from_arrays([kept.column(n) for n in names], names=names)

    return map_batches(docs, one, docs.schema)
