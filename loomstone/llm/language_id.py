"""Language ID: unigram models over a fixed public vocabulary, summed over every segmentation.

A language's model is a probability for each piece of a public subword vocabulary. A word's
likelihood is the sum over all ways to cut it into pieces of the product of their probabilities,
which the forward algorithm gives; a text's is the product over its words. Sums are rescaled as they
go, so a run of letters of any length has its likelihood, whatever the script. Expectation-maximisation
with forward and backward sums over the words of a bounded labelled sample fits the probabilities.
Scoring computes each distinct word of a batch once, for all languages together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import shared, textkit

#: Labelled documents that a fit may use for each language, at most.
SAMPLE_PER_LANGUAGE = 400
#: Characters, of words padded to the longest of their group, that are scored together.
_GROUP = 1 << 18
#: Positions between two rescalings. Sums shrink by 1e-10 a position at most, so those in reach of a piece stay normal numbers.
_RESCALE = 8
_KEPT_BYTES = 24 << 20
_MARK = "▁"


@dataclass
class Model:
    languages: list[str]
    pieces: dict[str, int]
    #: One row per piece and one for a character that is in no piece; a column per language; natural logarithms.
    log_p: np.ndarray

    @cached_property
    def finder(self) -> Finder:
        return Finder(self.pieces)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "finder"}


def load_pieces(path: str | None = None) -> dict[str, int]:
    """The vocabulary's pieces, in lower case where it has both."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    found = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            piece = model.id_to_piece(i)
            if piece == piece.lower():
                found[piece] = len(found)
    return found


class Finder:
    """Every place where a piece of the vocabulary stands in a word, by an Aho-Corasick automaton."""

    def __init__(self, pieces: dict[str, int]) -> None:
        self.unknown = len(pieces)
        self.size = np.array([*map(len, pieces), 1], dtype=np.int64)
        self.longest = int(self.size.max())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece, number in pieces.items():
            self.automaton.add_word(piece, number)
        if pieces:
            self.automaton.make_automaton()

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """All places where a piece fits, as (word, start, end, piece), ordered by end, then word. Any single character fits as itself or as unknown."""
        joined = "\n".join(_MARK + w for w in words)
        lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
        begins = np.cumsum(lengths + 1) - (lengths + 1)
        hits = np.fromiter((x for hit in self.automaton.iter(joined) for x in hit), np.int64) if self.unknown else np.empty(0, np.int64)
        stop, which = hits[::2] + 1, hits[1::2]
        single = np.zeros(len(joined) + 1, dtype=bool)
        single[stop[self.size[which] == 1]] = True
        every = textkit.spread(begins + 1, lengths)
        bare = every[~single[every]]
        stop, which = np.concatenate([stop, bare]), np.concatenate([which, np.full(len(bare), self.unknown)])
        word = np.searchsorted(begins, stop - 1, side="right") - 1
        end = stop - begins[word]
        order = np.lexsort((word, end))
        word, end, which = word[order], end[order], which[order]
        return word, end - self.size[which], end, which


def _groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of words in groups of like length, shortest first, of bounded size."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        # A group of n words is as wide as its last; the widths ascend, so n times the width does too.
        width = lengths[order[at : at + _GROUP]] * np.arange(1, min(_GROUP, len(order) - at) + 1)
        n = max(1, int(np.searchsorted(width, _GROUP, "right")))
        yield order[at : at + n]
        at += n


def _forward(lengths: np.ndarray, edges: tuple[np.ndarray, ...], p: np.ndarray, reach: int) -> np.ndarray:
    """The logarithm of the sum over each word's segmentations, for each language; words by ascending length.

    Only the sums within a piece's reach are kept, in a ring, and rescaled together.
    """
    word, start, end, which = edges
    longest, ring = int(lengths[-1]), reach + 1
    alpha = np.zeros((len(lengths), ring, p.shape[1]))
    alpha[:, 0] = 1
    scale = np.zeros((len(lengths), p.shape[1]))
    out = np.empty_like(scale)
    bounds = np.searchsorted(end, np.arange(longest + 2))
    done = np.searchsorted(lengths, np.arange(longest + 2))
    first = np.r_[True, (word[1:] != word[:-1]) | (end[1:] != end[:-1])]
    from_slot = start % ring
    for e in range(1, longest + 1):
        a, b = bounds[e], bounds[e + 1]
        at = np.flatnonzero(first[a:b])  # every word that goes on has an edge here
        alpha[done[e] :, e % ring] = np.add.reduceat(alpha[word[a:b], from_slot[a:b]] * p[which[a:b]], at)
        if e % _RESCALE == 0:
            most = alpha[done[e] :].max(axis=1)
            alpha[done[e] :] /= most[:, None]
            scale[done[e] :] += np.log(most)
        if done[e + 1] > done[e]:
            ended = slice(done[e], done[e + 1])
            out[ended] = np.log(alpha[ended, e % ring]) + scale[ended]
    return out


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Natural log-likelihood of each word (a row) in each language (a column)."""
    out = np.empty((len(words), len(model.languages)))
    p = np.exp(model.log_p)
    lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
    for part in _groups(lengths):
        out[part] = _forward(lengths[part], model.finder.edges([words[i] for i in part]), p, model.finder.longest)
    return out


def _expected(lengths: np.ndarray, edges: tuple[np.ndarray, ...], log_p: np.ndarray) -> np.ndarray:
    """The share of each edge in its word's segmentations, by forward and backward sums of logarithms."""
    word, start, end, which = edges
    n, longest = len(lengths), int(lengths.max())
    ahead, behind = (np.full((n, longest + 1), -np.inf) for _ in range(2))
    ahead[:, 0] = 0
    behind[np.arange(n), lengths] = 0
    gain = log_p[which]

    def sums(into: np.ndarray, out_of: np.ndarray, table: np.ndarray, steps: range) -> None:
        order = np.lexsort((word, into))
        bounds = np.searchsorted(into[order], np.arange(longest + 2))
        for k in steps:
            at = order[bounds[k] : bounds[k + 1]]
            if len(at):
                first = np.flatnonzero(np.r_[True, word[at][1:] != word[at][:-1]])
                table[word[at][first], k] = np.logaddexp.reduceat(table[word[at], out_of[at]] + gain[at], first)

    sums(end, start, ahead, range(1, longest + 1))
    sums(start, end, behind, range(longest - 1, -1, -1))
    return np.exp(ahead[word, start] + gain + behind[word, end] - behind[word, 0])


def fit_words(counts: dict[str, dict[str, float]], pieces: dict[str, int], rounds: int = 4, prior: float = 0.02) -> Model:
    """Fit by expectation-maximisation to word counts per language; `prior` is added to each piece's expected count."""
    languages = sorted(counts)
    log_p = np.empty((len(pieces) + 1, max(1, len(languages))))
    finder = Finder(pieces)
    size = finder.size.astype(float)
    for column, language in enumerate(languages):
        words = [w for w in counts[language] if w]
        weight = np.array([counts[language][w] for w in words], dtype=float)
        lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
        groups = [(part, finder.edges([words[i] for i in part])) for part in _groups(lengths)]
        log = np.log(0.05) * size
        log -= np.logaddexp.reduce(log)
        for _ in range(rounds):
            expected = np.full(len(size), prior)
            for part, edges in groups:
                expected += np.bincount(edges[3], _expected(lengths[part], edges, log) * weight[part][edges[0]], minlength=len(size))
            log = np.log(expected / expected.sum())
        log_p[:, column] = log
    return Model(languages, pieces, log_p)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; false for a null id, which is not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(spark: SparkSession, documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, pieces_path: str | None = None) -> Model:
    """Learn from labelled documents that are not held out: the `per_language` of each language whose ids hash lowest.

    Only ids and labels are read to choose them; their whole texts are counted by word where they lie.
    """
    usable = documents.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    draw = F.xxhash64(F.lit(11), "doc_id")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], load_pieces(pieces_path), np.zeros((1, 0)))
    # The draw is uniform over 64 bits, so a threshold gives about twice the sample; the lowest of those are the sample.
    span = 1 << 64
    limit = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, -(1 << 63) + min(span - 1, int(span * min(1.0, 2 * per_language / n))))))
    chosen = usable.filter(draw <= limit[F.col("lang")]).select("lang", "doc_id", draw.alias("draw"))
    picked: dict[str, set[int]] = {}
    for lang in sorted(sizes):
        lowest = chosen.filter(F.col("lang") == lang).orderBy("draw").limit(per_language)
        picked[lang] = {r["draw"] for r in lowest.collect()}
    draws = spark.createDataFrame([(lang, d) for lang, ds in picked.items() for d in sorted(ds)], "lang string, draw long")
    texts = usable.select("lang", draw.alias("draw"), F.lower("text").alias("text")).join(F.broadcast(draws), ["lang", "draw"], "left_semi")
    word = F.explode(F.split("text", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"))
    rows = texts.select("lang", word.alias("word")).filter("word != ''").groupBy("lang", "word").agg(F.count("*").alias("n")).collect()
    counts: dict[str, dict[str, float]] = {lang: {} for lang in sizes}
    for r in rows:
        counts[r["lang"]][r["word"]] = r["n"]
    return fit_words(counts, load_pieces(pieces_path))


class Scorer:
    """Log-likelihoods of the texts of Arrow arrays; a word is scored when first seen and found by its hash after that."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.slots = textkit.Slots(min(1_500_000, max(100_000, _KEPT_BYTES // (4 * max(1, len(model.languages))))))
        self.clear()

    def clear(self) -> None:
        self.slots.clear()
        self.scores = np.empty((1024, len(self.model.languages)), np.float32)

    def _learn(self, fresh: list[bytes], hashed: np.ndarray) -> None:
        each = word_scores([w.decode("utf-8", "replace") for w in fresh], self.model)
        slots = self.slots.add(hashed)
        while self.slots.count > len(self.scores):
            self.scores = np.resize(self.scores, (2 * len(self.scores), self.scores.shape[1]))
        self.scores[slots] = each

    def score(self, column: pa.Array) -> np.ndarray:
        data, offsets = textkit.utf8(pc.utf8_lower(column))
        starts, ends, counts = textkit.runs(data, offsets, textkit.LETTER)
        out = np.zeros((len(column), len(self.model.languages)))
        if not len(starts):
            return out
        hashed = textkit.hashes(data, starts, ends)
        slot = self.slots.find(hashed)
        new = np.flatnonzero(slot < 0)
        if len(new):
            fresh = new[textkit.first_of_each(hashed[new])]
            if self.slots.full(len(fresh)):
                self.clear()
                new, fresh = np.arange(len(hashed)), textkit.first_of_each(hashed)
            self._learn(textkit.span_bytes(data, starts[fresh], ends[fresh]), hashed[fresh])
            slot[new] = self.slots.find(hashed[new])
        some = np.flatnonzero(counts)
        out[some] = np.add.reduceat(self.scores[slot], (np.cumsum(counts) - counts)[some], dtype=np.float64)
        return out


def _best_of(cast: Broadcast) -> Callable:
    def best(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(cast.value)
        languages = pa.array([*cast.value.languages, "und"])
        for column in columns:
            name, share = [], []
            for piece in textkit.slices(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text"):
                logs = scorer.score(piece.column(0))
                if not logs.shape[1]:
                    name.append(np.zeros(len(logs), np.int64))
                    share.append(np.zeros(len(logs)))
                    continue
                name.append(logs.argmax(axis=1))
                share.append(1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1))
            empty = not name
            names = languages.take(pa.array(np.zeros(0, np.int64) if empty else np.concatenate(name)))
            shares = pa.array(np.zeros(0) if empty else np.concatenate(share))
            yield pa.StructArray.from_arrays([names, shares], names=["lang_pred", "score"])

    best.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return best


def predict(spark: SparkSession, texts: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`texts` with lang_pred and score, the share of the best language in the sum of the likelihoods.

    A null text, and one without a letter, is `und` with score 0, and so is every text if nothing was
    learned. Whole texts are scored, of any length.
    """
    shared.ship(spark)
    cast = spark.sparkContext.broadcast(model)  # a fixed vocabulary by the number of languages
    best = F.arrow_udf(_best_of(cast), "struct<lang_pred string, score double>")
    known = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.languages))
    scored = texts.withColumn("__best", best(F.col(f"`{text}`"))).withColumn("__known", known)
    return scored.withColumns({"lang_pred": F.when(F.col("__known"), F.col("__best.lang_pred")).otherwise("und"), "score": F.when(F.col("__known"), F.col("__best.score")).otherwise(0.0)}).drop("__best", "__known")


def identify_documents(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The op9 contract: doc_id, held_out, lang_pred, score for every row of documents."""
    model = fit(spark, shared.only(documents, "doc_id", "text", "lang"))
    out = predict(spark, shared.only(documents, "doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
