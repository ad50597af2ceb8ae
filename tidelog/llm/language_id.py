"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary
(the letter pieces of a sentencepiece model). The probability of a word is the
sum over all its segmentations into pieces, by the forward algorithm; that of a
text is the product over its words. The prediction is the language with the
highest probability, its score the posterior under equal priors. A word is a
letter with the letters and combining marks that follow it.

Training: expectation maximisation (forward-backward over the same lattices) on
a bounded sample, about ``SAMPLE_DOCS`` documents of each language, chosen by a
hash of the id, with all their words. Each language is learned by a task of its
own; the driver gets one probability a piece and language. Scoring covers every
word of every text. Words of up to ``LOCKSTEP`` letters go through the lattices
many at a time; longer ones one by one, scaled so that they do not underflow.

Defined results: null text, empty text and text without a letter are ``und``
with score 0, as is every text where no labelled row could be learned from. Ties
go to the language that sorts first. Rows that repeat an id are learned from and
scored each on its own. Rows are never dropped or merged. Columns of the input
may have any names; an added column replaces one of the same name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.arrow_columns import with_python_columns
from tidelog.llm.tables import table
from tidelog.llm.worker_cache import claim

VOCABULARY = "piece_bpe_32k.model"
SAMPLE_DOCS, LOCKSTEP = 600, 60
ROUNDS, SMOOTHING, UNKNOWN = 4, 0.05, 1e-7
#: Words that a worker keeps, and their probabilities in all languages; neither bound changes a result.
CACHE_WORDS, CACHE_VALUES, LEAST_CACHE = 250_000, 4_000_000, 2000
#: Letters of a long word looked up at once, and steps between its rescalings.
WINDOW, RESCALE = 50_000, 16
UNDETERMINED, MARK = "und", "▁"
LETTERS, ASCII = regex.compile(r"\p{L}[\p{L}\p{M}]*"), re.compile("[a-z]+")
LETTERS_ONLY = regex.compile(r"[\p{L}\p{M}]*")


def words_of(text: str) -> list[str]:
    """Lower-case letters with the letters and marks that follow them."""
    return (ASCII if text.isascii() else LETTERS).findall(text.lower())


def vocabulary(path: str) -> list[str]:
    """Letter pieces of the sentencepiece model at ``path``, lower-cased, with the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if LETTERS_ONLY.fullmatch(p.removeprefix(MARK)))


class Lattices:
    """Forward (and backward) sums over the segmentations of many words at once."""

    def __init__(self, pieces: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(pieces):
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)

    def arcs(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Arcs (word, start, end, piece) by end; piece is -1 for the arc of one unknown character."""
        spans = np.array([len(w) + 1 for w in words], dtype=np.int64)
        first = np.cumsum(spans) - spans
        text = MARK + MARK.join(words)
        hits = np.array(list(self.automaton.iter(text)), dtype=np.int64).reshape(-1, 2)
        word = np.searchsorted(first, hits[:, 0], side="right") - 1
        end = hits[:, 0] - first[word] + 1
        every = np.repeat(np.arange(len(words)), spans)
        ends = np.arange(len(text)) - first[every] + 1
        word, piece = np.concatenate([word, every]), np.concatenate([hits[:, 1], np.full(len(every), -1)])
        start = np.concatenate([end - self.lengths[hits[:, 1]], ends - 1])
        end = np.concatenate([end, ends])
        order = np.lexsort((word, end))
        return word[order], start[order], end[order], piece[order], spans

    @staticmethod
    def forward(arcs: tuple[np.ndarray, ...], weights: np.ndarray) -> np.ndarray:
        """alpha[position, word, language]; weights: by piece and language, the last row for piece -1."""
        word, start, end, piece, spans = arcs
        alpha = np.zeros((int(spans.max()) + 1, len(spans), weights.shape[1]))
        alpha[0] = 1.0
        bounds = np.searchsorted(end, np.arange(1, int(spans.max()) + 2))
        for at, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), 1):
            w = word[a:b]
            heads = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            alpha[at, w[heads]] = np.add.reduceat(alpha[start[a:b], w] * weights[piece[a:b]], heads)
        return alpha

    def log_probability(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """log P(word | language), one row per word."""
        out = np.empty((len(words), weights.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= LOCKSTEP]
        if short:
            arcs = self.arcs([words[i] for i in short])
            out[short] = np.log(np.maximum(self.forward(arcs, weights)[arcs[4], np.arange(len(short))], 1e-300))
        for i, word in enumerate(words):
            if len(word) > LOCKSTEP:
                out[i] = self.long_forward(word, weights)
        return out

    def long_forward(self, word: str, weights: np.ndarray) -> np.ndarray:
        """log P(word | language) of one word of any length, with the last few sums in memory only."""
        text, reach = MARK + word, int(self.lengths.max(initial=1))
        ring, scale = np.zeros((reach + 1, weights.shape[1])), np.zeros(weights.shape[1])
        ring[0] = 1.0
        for begin in range(0, len(text), WINDOW):
            before = max(0, begin - reach)
            ending: dict[int, list[int]] = {}
            for last, piece in self.automaton.iter(text[before : begin + WINDOW]):
                ending.setdefault(before + last + 1, []).append(piece)
            for at in range(begin + 1, min(begin + WINDOW, len(text)) + 1):
                pieces = np.array([*(p for p in ending.get(at, ()) if self.lengths[p] <= at), -1])
                starts = at - np.where(pieces >= 0, self.lengths[pieces], 1)
                ring[at % (reach + 1)] = (ring[starts % (reach + 1)] * weights[pieces]).sum(0)
                if at % RESCALE == 0:
                    most = ring.max(0)
                    ring /= most
                    scale += np.log(most)
        return np.log(np.maximum(ring[len(text) % (reach + 1)], 1e-300)) + scale

    def expected(self, words: list[str], counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations, for one language."""
        short = np.array([len(w) <= LOCKSTEP for w in words], dtype=bool)
        use = np.zeros(len(self.lengths))
        if short.any():
            use += self._expected([w for w, s in zip(words, short, strict=True) if s], counts[short], weights)
        for i in np.flatnonzero(~short):
            use += counts[i] * self._expected_long(words[i], weights)
        return use

    def _expected(self, words: list[str], counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
        arcs = self.arcs(words)
        word, start, end, piece, spans = arcs
        alpha = self.forward(arcs, weights[:, None])[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[spans, np.arange(len(words))] = 1.0
        p = weights[piece]
        bounds = np.searchsorted(end, np.arange(1, int(spans.max()) + 2))
        for at in range(int(spans.max()), 0, -1):
            a, b = bounds[at - 1], bounds[at]
            np.add.at(beta, (start[a:b], word[a:b]), p[a:b] * beta[at, word[a:b]])
        total = np.maximum(alpha[spans, np.arange(len(words))], 1e-300)
        use = alpha[start, word] * p * beta[end, word] * (counts / total)[word]
        known = piece >= 0
        return np.bincount(piece[known], weights=use[known], minlength=len(self.lengths))

    def _expected_long(self, word: str, weights: np.ndarray) -> np.ndarray:
        """The same for one long word, in logarithms."""
        _, start, end, piece, spans = self.arcs([word])
        n, p = int(spans[0]), np.log(weights[piece])
        bounds = np.searchsorted(end, np.arange(1, n + 2))
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0.0
        for at in range(1, n + 1):
            arcs = slice(bounds[at - 1], bounds[at])
            alpha[at] = np.logaddexp.reduce(alpha[start[arcs]] + p[arcs])
        for at in range(n, 0, -1):
            arcs = slice(bounds[at - 1], bounds[at])
            np.logaddexp.at(beta, start[arcs], p[arcs] + beta[at])
        known = piece >= 0
        return np.bincount(piece[known], weights=np.exp(alpha[start] + p + beta[end] - alpha[n])[known], minlength=len(self.lengths))


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    weights: np.ndarray  # by piece (and one row for unknown characters) and language


def probabilities(lattices: Lattices, counts: dict[str, int]) -> np.ndarray:
    """One language's piece probabilities (and that of an unknown character) from its word counts."""
    words = sorted(counts, key=lambda w: (len(w), w))  # lattices of like length share their steps
    n, size = np.array([counts[w] for w in words], dtype=float), len(lattices.lengths)
    weights = np.append(np.full(size, 1.0 / size), UNKNOWN)
    for _ in range(ROUNDS):
        use = np.zeros(size)
        for at in range(0, len(words), 4000):
            use += lattices.expected(words[at : at + 4000], n[at : at + 4000], weights)
        use += SMOOTHING
        weights = np.append(use / use.sum() * (1 - UNKNOWN), UNKNOWN)
    return weights


def model_of(columns: dict[str, np.ndarray], pieces: list[str]) -> LanguageModel:
    languages = sorted(columns)
    return LanguageModel(languages, pieces, np.stack([columns[x] for x in languages], 1) if columns else np.zeros((len(pieces) + 1, 0)))


def train(counts: dict[str, Counter], pieces: list[str]) -> LanguageModel:
    """Piece probabilities of each language from its word counts."""
    lattices = Lattices(pieces)
    return model_of({x: probabilities(lattices, c) for x, c in counts.items()}, pieces)


def scorer(model: LanguageModel) -> Callable[[pa.Array], list[pa.Array]]:
    """The function from texts to (lang_pred, score), with a bounded cache of words."""
    claim("language_id")
    lattices, wide = Lattices(model.pieces), max(1, len(model.languages))
    room = max(LEAST_CACHE, min(CACHE_WORDS, CACHE_VALUES // wide))
    cache: dict[str, int] = {}
    table_ = np.zeros((1024, wide))

    def learn(words: set[str]) -> None:
        """Have all of ``words`` (no more than there is room for) in the cache."""
        nonlocal table_
        new = [w for w in words if w not in cache]
        if len(cache) + len(new) > room:
            cache.clear()
            new = list(words)
        while len(cache) + len(new) > len(table_):
            table_ = np.concatenate([table_, np.zeros_like(table_)])
        new.sort(key=len)  # lattices of like length share their steps
        size = max(64, 16_000 // wide)  # bounds the lattices' memory
        for at in range(0, len(new), size):
            part = new[at : at + size]
            table_[len(cache) : len(cache) + len(part)] = lattices.log_probability(part, model.weights)
            cache.update(zip(part, range(len(cache), len(cache) + len(part)), strict=True))

    def told(total: np.ndarray) -> tuple[str, float]:
        best = int(total.argmax())
        return model.languages[best], float(1.0 / np.exp(total - total[best]).sum())

    def sums(words: list[str]) -> np.ndarray:
        return table_[np.fromiter(map(cache.__getitem__, words), np.int64, len(words))].sum(0)

    def score(texts: pa.Array) -> list[pa.Array]:
        found = [words_of(t) if t else [] for t in texts.to_pylist()]
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(found)
        held: list[int] = []
        wanted: set[str] = set()

        def flush() -> None:
            learn(wanted)
            for i in held:
                out[i] = told(sums(found[i]))
            held.clear()
            wanted.clear()

        for i, words in enumerate(found if model.languages else ()):
            if len(words) > room and len(set(words)) > room:  # in parts, each summed apart
                total = np.zeros(wide)
                for at in range(0, len(words), room):
                    learn(set(words[at : at + room]))
                    total += sums(words[at : at + room])
                out[i] = told(total)
            elif words:
                new = set(words).difference(wanted)
                if len(wanted) + len(new) > room:
                    flush()
                    new = set(words)
                held.append(i)
                wanted.update(new)
        flush()
        names, scores = zip(*out, strict=True) if out else ((), ())
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return score


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out of all training."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def word_counts(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, word, n): counts of the words of a bounded sample of the labelled rows."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))  # one row a language
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.join(F.broadcast(sizes), "lang").filter(place * F.col("rows") < sample_docs).select("lang", "text")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                found = Counter(w for t in texts for w in words_of(t))
                yield pd.DataFrame({"lang": lang, "word": list(found), "n": list(found.values())})

    return sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def fit(docs: DataFrame, path: str | None = None) -> LanguageModel:
    """Learn from the labelled documents that are not held out, each language in a task of its own."""
    path = path or vocabulary_path()

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        claim("language_id")
        weights = probabilities(Lattices(vocabulary(path)), dict(zip(rows["word"], rows["n"], strict=True)))
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "weights": [weights.tobytes()]})

    learned = word_counts(docs).groupBy("lang").applyInPandas(learn, "lang string, weights binary").collect()
    return model_of({r["lang"]: np.frombuffer(r["weights"]) for r in learned}, vocabulary(path))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` plus lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a piece and language
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return with_python_columns(docs, [("text", fields, lambda: scorer(shared.value))])


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "lang", "text"))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
