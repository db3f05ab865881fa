"""Language of words and documents by a linear-chain conditional random field.

Words are labelled with languages. A word's features are its affixes, its letter n-grams and
its place in per-language lexicons, hashed into a table of learned weights; neighbouring
labels are tied by learned transitions. The field is trained on code-switched sequences
spliced from a bounded sample of labelled documents, by gradients of the likelihood from
forward-backward. Prediction runs forward-backward over all words of a text; a document's
language has the largest posterior mass over its words, and the score is that share.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from swellframe.llm.batches import map_batches

LETTERS = r"\p{L}+"
UNDETERMINED = "und"

# The field is fitted on at most so many documents per language, those whose ids have the
# smallest hashes, and of each a number of stretches, evenly over the whole text, that have
# so many characters together.
FIT_DOCUMENTS = 400
FIT_CHARS, FIT_STRETCHES = 4000, 4
LEXICON_WORDS = 300
# Code-switched training sequences: words in a sequence, and in a stretch of one language.
SEQUENCES, SEQUENCE_WORDS, STRETCH_WORDS = 3000, 40, 12
EPOCHS, BATCH, RATE, DECAY = 4, 100, 0.4, 1e-6
BUCKETS = 1 << 16
SEED = 20240131
# Words of a language in a piece of text that certainty is calibrated on, pieces remembered
# per language, and the steps that certainty is counted in (a power of two, so exact).
PIECE_WORDS, PIECES, CERTAINTY_STEPS = 3, 50, 1 << 12
# Words whose weights a task remembers, and rows whose chains run side by side.
CACHED_WORDS = 200_000
SIDE_BY_SIDE = 512
SIDE_BYTES = 2 << 20


def feature_names(word: str) -> list[str]:
    edged = f"^{word}$"
    grams = [edged[i : i + n] for n in (2, 3) for i in range(len(edged) - n + 1)]
    starts = [f"<{word[:n]}" for n in (1, 2, 3, 4)]
    return grams + starts + [f">{word[-n:]}" for n in (1, 2, 3, 4)]


@dataclass
class Field:
    """Languages, hashed feature weights, transition weights, and lexicons by word."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, tuple[int, ...]] = field(default_factory=dict)
    pieces: list[list[str]] = field(default_factory=list)

    def features(self, word: str) -> list[int]:
        names = feature_names(word)
        if (places := self.lexicon.get(word)) is not None:
            names += [f"={word}", *(f"#{place}" for place in places)]
        return [zlib.crc32(name.encode()) % BUCKETS for name in names]

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of the languages for each word by itself."""
        found = [self.features(word) for word in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        rows = self.weights[np.concatenate([np.asarray(x, np.int64) for x in found])]
        return np.add.reduceat(rows, np.cumsum(sizes) - sizes, axis=0)


class Chains:
    """Sequences laid side by side, longest first, so that one step serves all of them."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.rank = np.empty(len(lengths), np.int64)
        self.rank[self.order] = np.arange(len(lengths))
        ordered = lengths[self.order]
        steps = int(ordered[0]) if len(ordered) else 0
        self.width = np.searchsorted(-ordered, -np.arange(steps), side="left")
        self.start = np.cumsum(self.width) - self.width
        # Place of each word, given in the order of sequences, in the step-by-step layout.
        sequence = np.repeat(np.arange(len(lengths)), lengths)
        step = np.arange(len(sequence)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.place = self.start[step] + self.rank[sequence] if len(sequence) else step

    def posteriors(self, emissions: np.ndarray, transitions: np.ndarray):
        """Label posteriors of each word, and expected transitions summed over all words."""
        n, k = emissions.shape
        scores = np.empty((n, k), np.float32)
        scores[self.place] = np.exp(emissions - emissions.max(1, keepdims=True))
        step = np.exp(transitions).astype(np.float32)
        ahead, back = np.empty_like(scores), np.empty_like(scores)
        pairs = np.zeros((k, k))
        before = None
        for start, width in zip(self.start, self.width, strict=True):
            now = scores[start : start + width]
            now = now / k if before is None else (before[:width] @ step) * now
            now /= now.sum(1, keepdims=True)
            ahead[start : start + width] = before = now
        after = None
        for i in range(len(self.width) - 1, -1, -1):
            start, width = self.start[i], self.width[i]
            now = np.full((width, k), 1.0 / k, np.float32)
            if after is not None and len(after):
                now[: len(after)] = after @ step.T
                now /= now.sum(1, keepdims=True)
            back[start : start + width] = now
            if i:
                after = scores[start : start + width] * now
                left = ahead[self.start[i - 1] : self.start[i - 1] + width]
                joint = step * (left.T @ (after / np.maximum(((left @ step) * after).sum(1, keepdims=True), 1e-30)))
                pairs += joint
        ahead *= back
        ahead /= np.maximum(ahead.sum(1, keepdims=True), 1e-30)
        return ahead[self.place], pairs


def spliced(samples: dict[str, list[list[str]]], rng: np.random.Generator):
    """Code-switched sequences: stretches from documents of languages drawn at random."""
    languages = sorted(samples)
    for _ in range(SEQUENCES):
        words: list[str] = []
        labels: list[int] = []
        while len(words) < SEQUENCE_WORDS:
            label = int(rng.integers(len(languages)))
            source = samples[languages[label]]
            text = source[int(rng.integers(len(source)))]
            at = int(rng.integers(max(1, len(text) - STRETCH_WORDS)))
            part = text[at : at + int(rng.integers(1, 2 * STRETCH_WORDS))]
            words += part
            labels += [label] * len(part)
        yield words, labels


def train(samples: dict[str, list[list[str]]], seed: int = SEED) -> Field:
    """Fits weights and transitions by stochastic gradients with per-weight rates."""
    languages = sorted(samples)
    k, rng = len(languages), np.random.default_rng(seed)
    lexicon: dict[str, list[int]] = {}
    for place, language in enumerate(languages):
        counts = Counter(word for text in samples[language] for word in text)
        for word, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS]:
            lexicon.setdefault(word, []).append(place)
    fitted = Field(
        languages,
        np.zeros((BUCKETS, k), np.float32),
        np.zeros((k, k), np.float32),
        {word: tuple(places) for word, places in lexicon.items()},
    )
    if k < 2:
        return fitted
    sequences = list(spliced(samples, rng))
    squares, transition_squares = np.full((BUCKETS, k), 1e-4, np.float32), np.full((k, k), 1e-4)
    known: dict[str, np.ndarray] = {}
    for _ in range(EPOCHS):
        order = rng.permutation(len(sequences))
        for first in range(0, len(order), BATCH):
            chosen = [sequences[i] for i in order[first : first + BATCH]]
            words = [word for text, _ in chosen for word in text]
            labels = np.array([label for _, marks in chosen for label in marks])
            for word in set(words) - known.keys():
                known[word] = np.asarray(fitted.features(word), np.int64)
            found = [known[word] for word in words]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.concatenate(found)
            scores = np.add.reduceat(fitted.weights[flat], np.cumsum(sizes) - sizes, axis=0)
            lengths = np.array([len(text) for text, _ in chosen])
            posteriors, pairs = Chains(lengths).posteriors(scores, fitted.transitions)
            posteriors[np.arange(len(labels)), labels] -= 1.0
            gradient = np.zeros_like(fitted.weights)
            np.add.at(gradient, flat, np.repeat(posteriors, sizes, axis=0))
            gradient = gradient / len(chosen) + DECAY * fitted.weights
            squares += gradient**2
            fitted.weights -= (RATE * gradient / np.sqrt(squares)).astype(np.float32)
            ends = np.cumsum(lengths)
            inside = np.ones(len(labels), bool)
            inside[ends - 1] = False
            at = np.flatnonzero(inside)
            np.add.at(pairs, (labels[at], labels[at + 1]), -1.0)
            pairs = pairs / len(chosen)
            transition_squares += pairs**2
            fitted.transitions -= (RATE * pairs / np.sqrt(transition_squares)).astype(np.float32)
    return fitted


def held_out(key: str = "doc_id"):
    """Rows that are never learned from: a fifth by the key's CRC, and those without a key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))


def stretches(text: Column, chars: int, number: int = FIT_STRETCHES) -> Column:
    """A text of at most ``chars`` characters, or stretches of that many from all over it."""
    long = F.char_length(text)
    size = chars // number
    parts = [F.substring(text, F.floor((long - size) * i / (number - 1)).cast("int") + 1, F.lit(size)) for i in range(number)]
    return F.when(long <= chars, text).otherwise(F.concat_ws(" ", *parts))


def fit(docs: DataFrame, documents: int = FIT_DOCUMENTS, chars: int = FIT_CHARS) -> Field:
    """Field from a bounded sample of documents that have a language and are not held out.

    Rows without text, language or id are not learned from. Without any, no language is known.
    Repeated rows are rows of the sample, which never holds more than its bound.
    """
    import regex

    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    ranks = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    sampled = usable.select("doc_id", "lang", stretches(F.col("text"), chars).alias("text"))
    chosen = sampled.withColumn("place", F.row_number().over(ranks)).filter(F.col("place") <= documents)
    rows = chosen.select("doc_id", "lang", "text").collect()
    letters = regex.compile(LETTERS)
    samples: dict[str, list[list[str]]] = {}
    for row in sorted(rows, key=lambda row: (row["lang"], row["doc_id"], row["text"])):
        if words := letters.findall(row["text"].lower()):
            samples.setdefault(row["lang"], []).append(words)
    fitted = train(samples)
    fitted.pieces = [piece(words) for language in sorted(samples) for words in samples[language][:PIECES]]
    return fitted


def piece(words: list[str]) -> list[str]:
    """A few words from the middle."""
    at = max(0, (len(words) - PIECE_WORDS) // 2)
    return words[at : at + PIECE_WORDS]


class _Emissions:
    """Word scores, remembered for the words seen last."""

    def __init__(self, fitted: Field):
        self.fitted = fitted
        self.places: dict[str, int] = {}
        self.scores = np.zeros((0, len(fitted.languages)), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        new = [word for word in dict.fromkeys(words) if word not in self.places]
        if len(self.places) + len(new) > CACHED_WORDS and self.places:
            self.places, self.scores = {}, self.scores[:0]
            new = list(dict.fromkeys(words))
        if new:
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
            self.scores = np.vstack([self.scores, self.fitted.emissions(new)])
        return self.scores[np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))]


def _word_lists(texts: list[str | None]) -> list[list[str]]:
    import regex

    letters = regex.compile(LETTERS)
    return [letters.findall(text.lower()) if text else [] for text in texts]


def _labelled(fitted: Field, found: list[list[str]], emissions: _Emissions):
    """Languages, scores, certainties and word posteriors of word lists, which are emptied."""
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    names, scores, certain = [UNDETERMINED] * len(found), np.zeros(len(found)), np.zeros(len(found))
    if not fitted.languages or not lengths.any():
        return names, scores, certain, np.zeros((0, len(fitted.languages)))
    at = np.flatnonzero(lengths)
    scored = emissions.of([word for words in found for word in words])
    found.clear()
    posteriors, _ = Chains(lengths[at]).posteriors(scored, fitted.transitions)
    sizes = lengths[at]
    starts = np.cumsum(sizes) - sizes
    share = np.add.reduceat(posteriors, starts, axis=0, dtype=float) / sizes[:, None]
    certain[at] = np.add.reduceat(posteriors.max(1), starts, dtype=float) / sizes
    best = share.argmax(1)
    for i, place, value in zip(at, best, share.max(1), strict=True):
        names[i], scores[i] = fitted.languages[place], min(1.0, value)
    return names, scores, certain, posteriors


def label_texts(fitted: Field, texts: list[str | None], emissions: _Emissions | None = None):
    """Languages, scores, and the word posteriors of each text."""
    emissions = emissions or _Emissions(fitted)
    names, scores, _, posteriors = _labelled(fitted, _word_lists(texts), emissions)
    return names, scores, posteriors


def predict(docs: DataFrame, fitted: Field, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` from the text alone.

    Texts that are null or have no letters are ``und`` with score 0, as is everything if no
    language was learned. Repeated rows are predicted each.
    """

    def make():
        emissions = _Emissions(fitted)

        def work(texts):
            names, scores, _ = label_texts(fitted, texts, emissions)
            return pa.array(names, pa.string()), pa.array(scores, pa.float64())

        return work

    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return map_batches(docs, keep, [text], added, make, rows=SIDE_BY_SIDE, most=SIDE_BYTES)


CERTAINTIES = ("lang_pred", "certainty", "hard_certainty")


def predict_certainty(
    docs: DataFrame, fitted: Field, keep: list[str], text: str = "text", names=CERTAINTIES
) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``certainty`` and ``hard_certainty`` from the text alone,
    under other ``names`` where these are taken.

    ``certainty`` is the mean over the words of their largest posterior: words in any mix of
    languages are certain, words of none are not. ``hard_certainty`` is the least one of the
    text, a few of its words by themselves, and these words before pieces of two other texts.
    """

    def make():
        emissions = _Emissions(fitted)

        def work(texts):
            found = _word_lists(texts)
            pieces = [piece(words) for words in found]
            mixed = []
            for words in pieces:
                at = zlib.crc32(" ".join(words).encode())
                others = [fitted.pieces[(at >> shift) % len(fitted.pieces)] for shift in (0, 12)]
                mixed.append(words + others[0] + others[1] if words else [])
            names, _, certain, _ = _labelled(fitted, found, emissions)
            alone = _labelled(fitted, pieces, emissions)[2]
            hard = np.minimum(np.minimum(certain, alone), _labelled(fitted, mixed, emissions)[2])
            return pa.array(names, pa.string()), pa.array(certain, pa.float64()), pa.array(hard, pa.float64())

        return work

    added = [StructField(names[0], StringType()), *(StructField(name, DoubleType()) for name in names[1:])]
    return map_batches(docs, keep, [text], added, make, rows=SIDE_BY_SIDE, most=SIDE_BYTES)


def least_certainty(predicted: DataFrame, loss: float, label: str = "lang", names=CERTAINTIES) -> float:
    """The largest certainty that at most ``loss`` of all labelled rows fall short of, even by
    their ``hard_certainty``; 0 without any. A bounded number of counts is collected."""
    step = F.floor(F.col(names[2]) * CERTAINTY_STEPS).alias("step")
    known = predicted.filter(F.col(label).isNotNull() & (F.col(names[0]) != UNDETERMINED))
    counts = sorted((r["step"], r["count"]) for r in known.groupBy(step).count().collect())
    allowed = loss * sum(count for _, count in counts)
    for value, count in counts:
        if count > allowed:
            return value / CERTAINTY_STEPS
        allowed -= count
    return 0.0
