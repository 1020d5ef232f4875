"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is
the sum, over all ways to cut it into pieces, of the product of the pieces' probabilities: a forward pass
over its characters. A text's score for a language is the log of its prior plus the logs of its words. The
answer is the language with the highest score, its confidence the normalised posterior.

Words are runs of letters, lower-cased, with the vocabulary's mark for a word's start before them. Piece
counts come from the public segmentation of all training words and are smoothed over the vocabulary; a
character that no piece covers has one small probability in all languages.

Cases: a null text, or one without a letter, is `und` with score 0; so is every text if nothing can be
learned from; ties go to the language first in code-point order; repeated rows and null ids are rows of
their own (a null id counts as the empty text in the fold); an empty table gives an empty table; columns
besides id, text and lang are ignored, and lang is never an input of a prediction.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fold, sliced, table, text_batches, tidy

MARK = "▁"
ALPHA = 0.1
UNKNOWN = 1e-9
#: Words from this length on are scored one by one, with rescaling.
SHORT = 26
#: Words in each of the memo's two generations: one fills, and what it asks of the one before moves over.
_MEMO = 150_000

letters = re.compile(r"[^\W\d_]+").findall


def text_words(text: str | None) -> list[str]:
    words = letters(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def usable(piece: str) -> bool:
    body = piece.removeprefix(MARK)
    return (body.isalpha() or piece == MARK) and body == body.lower()


class Model:
    """Piece probabilities of each language and the forward pass, with a memo of words."""

    def __init__(self, langs: list[str], priors: np.ndarray, pieces: dict[str, tuple[float, ...]]):
        self.langs, self.priors, self.pieces = langs, priors, pieces
        self.longest = max(map(len, pieces), default=1)
        self.starts = {p[:i] for p in pieces for i in range(1, len(p) + 1)}
        self.probs = np.array([*pieces.values(), (UNKNOWN,) * len(langs)], np.float64).reshape(len(pieces) + 1, len(langs))
        self._grow()
        self.row, self.before = {}, {}
        self.scores = self.scores_before = np.zeros((1024, len(langs)))

    def _grow(self) -> None:
        """The pieces as a trie of arrays. A code point has a state after the root, a column after other states and a piece."""
        state = {p: k for k, p in enumerate(self.starts)}
        self.piece = np.full(len(state), -1)
        for k, p in enumerate(self.pieces):
            self.piece[state[p]] = k
        later = {c: k for k, c in enumerate(sorted({p[-1] for p in state if len(p) > 1}), 1)}
        inner = {p: k for k, p in enumerate({p[:-1] for p in state if len(p) > 1}, 1)}
        self.inner = np.zeros(len(state), np.int64)  # row 0 and column 0 lead nowhere
        self.next = np.full((len(inner) + 1, len(later) + 1), -1, np.int32)
        self.none = max((ord(c) for p in state for c in p), default=0) + 1  # stands for all code points from here on
        self.root, self.column, self.single = np.full(self.none + 1, -1), np.zeros(self.none + 1, np.int64), np.full(self.none + 1, len(self.pieces))
        for p, k in state.items():
            self.inner[k] = inner.get(p, 0)
            if len(p) > 1:
                self.next[inner[p[:-1]], later[p[-1]]] = k
            else:
                self.root[ord(p)] = k
                if p in self.pieces:
                    self.single[ord(p)] = self.piece[k]
        for c, k in later.items():
            self.column[ord(c)] = k

    def forward(self, word: str) -> np.ndarray:
        s, k = MARK + word, len(self.langs)
        n = len(s)
        alpha = [None] * (n + 1)
        alpha[0], scale = [1.0] * k, 0.0
        for i in range(n):
            here = alpha[i]
            if (top := max(here)) < 1e-150:  # rescale all that the coming steps read
                for j in range(i, min(n, i + self.longest) + 1):
                    if alpha[j] is not None:
                        alpha[j] = [a / top for a in alpha[j]]
                here, scale = alpha[i], scale + np.log(top)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                part = s[i:j]
                if part not in self.starts and j > i + 1:
                    break
                p = self.pieces.get(part) or ((UNKNOWN,) * k if j == i + 1 else None)
                if p is not None:
                    old = alpha[j]
                    alpha[j] = [a * b for a, b in zip(here, p)] if old is None else [o + a * b for o, a, b in zip(old, here, p)]
        return np.log(np.maximum(alpha[n], 1e-300)) + scale

    def forward_many(self, words: list[str]) -> np.ndarray:
        """forward() of short words together: place by place, all words take a step through the trie at once."""
        codes = np.minimum(np.frombuffer("".join([MARK + w for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32), self.none)
        root, column, single = self.root[codes], self.column[codes], self.single[codes]
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        offsets, most = np.cumsum(lengths) - lengths, int(lengths.max())
        alpha = np.zeros((most + 1, len(words), len(self.langs)))
        alpha[0] = 1
        for i in range(most):
            at = np.flatnonzero(lengths > i)
            alpha[i + 1, at] += alpha[i, at] * self.probs[single[offsets[at] + i]]  # a word and end occur once for each start
            state = root[offsets[at] + i]
            for j in range(i + 2, most + 1):
                on = (state >= 0) & (lengths[at] >= j)
                at, state = at[on], state[on]
                if not len(at):
                    break
                state = self.next[self.inner[state], column[offsets[at] + j - 1]]
                piece = self.piece[state]
                hit = (state >= 0) & (piece >= 0)
                to = at[hit]
                alpha[j, to] += alpha[i, to] * self.probs[piece[hit]]
        return np.log(np.maximum(alpha[lengths, np.arange(len(words))], 1e-300))

    def learn(self, words: set[str]) -> None:
        """Puts the words' scores into the memo."""
        new = [w for w in words if w not in self.row]
        if len(self.row) + len(new) > _MEMO:
            self.before, self.scores_before = self.row, self.scores
            self.row, self.scores, new = {}, np.zeros((1024, len(self.langs))), list(words)
        known = [w for w in new if w in self.before]
        new = [w for w in new if w not in self.before]
        short, long = [w for w in new if len(w) < SHORT], [w for w in new if len(w) >= SHORT]
        at, more = len(self.row), len(known) + len(new)
        while len(self.scores) < at + more:
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        if known:
            self.scores[at : at + len(known)] = self.scores_before[[self.before[w] for w in known]]
        self.row.update(zip(known + short + long, range(at, at + more)))
        at += len(known)
        for i in range(0, len(short), 5000):
            self.scores[at + i : at + i + len(short[i : i + 5000])] = self.forward_many(short[i : i + 5000])
        for i, w in enumerate(long, at + len(short)):
            self.scores[i] = self.forward(w)

    def text_scores(self, words: list[str]) -> np.ndarray:
        return self.scores[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(axis=0)

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for i in range(0, len(texts), 500):
            split = [text_words(t) for t in texts[i : i + 500]]
            if self.langs:
                self.learn(set().union(*split))
            out += map(self.judge, split)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def judge(self, words: list[str]) -> tuple[str, float]:
        if not words or not self.langs:
            return "und", 0.0
        x = self.priors + self.text_scores(words)
        x = np.exp(x - x.max())
        best = int(x.argmax())
        return self.langs[best], float(x[best] / x.sum())


def train(docs: DataFrame, vocabulary: str) -> Model:
    """Counts pieces by language over all rows given. A task sends at most (languages x pieces) sums."""
    text_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        proto = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(proto)

    def count(batches):
        pieces = sentencepiece.SentencePieceProcessor(model_proto=sent.value)
        sums: Counter = Counter()
        by_lang: dict[str, Counter] = {}

        def cut():
            for lang, words in by_lang.items():
                for ids, times in zip(pieces.encode(list(words), num_threads=1), words.values()):
                    for i in ids:
                        sums[lang, i] += times
            by_lang.clear()

        for batch in sliced(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[lang, -1] += 1
                by_lang.setdefault(lang, Counter()).update(text_words(text))
            if sum(map(len, by_lang.values())) > _MEMO:
                cut()
            if len(sums) > 1_000_000:
                yield _batch(sums)
                sums.clear()
        cut()
        yield _batch(sums)

    def _batch(sums):
        keys = list(sums)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(sums.values()), pa.int64())], ["lang", "piece", "n"])

    found = docs.select("text", "lang").where("lang is not null").mapInArrow(tidy(count), "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()  # languages x pieces
    langs = sorted({r["lang"] for r in found}, key=lambda x: x.encode())
    vocab = sentencepiece.SentencePieceProcessor(model_proto=proto)
    names = {i: p for i in range(vocab.get_piece_size()) if usable(p := vocab.id_to_piece(i))}
    place = {i: k for k, i in enumerate(names)}
    counts, n_docs = np.full((len(names), len(langs)), ALPHA), np.ones(len(langs))
    for lang, piece, n in found:
        if piece == -1:
            n_docs[langs.index(lang)] = n
        elif piece in place:
            counts[place[piece], langs.index(lang)] += n
    share = counts / counts.sum(axis=0)
    return Model(langs, np.log(n_docs / n_docs.sum()), {p: tuple(share[k].tolist()) for p, k in zip(names.values(), range(len(names)))})


_models: dict = {}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id`, `lang_pred`, `score` of every row: one pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.priors, model.pieces))
    key = uuid.uuid4().hex

    def run(batches):
        if key not in _models:
            _models.clear()
            _models[key] = Model(*sent.value)
        for batch in sliced(batches):
            out = _models[key].predict_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose language is known with a score of at least `least`."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.priors, model.pieces))
    key, at = uuid.uuid4().hex, docs.columns.index("text")

    def run(batches):
        if key not in _models:
            _models.clear()
            _models[key] = Model(*sent.value)
        for batch in sliced(batches):
            found = _models[key].predict_all(batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))
        _models.clear()

    return docs.mapInArrow(tidy(run), docs.schema)


def learned(docs: DataFrame, vocabulary: str | None = None) -> Model:
    """The model of the contract's training fold: ids whose crc32 modulo 5 is not 0."""
    import public_tokenizers

    return train(docs.where(fold(F.col("doc_id"), 5) != 0), vocabulary or public_tokenizers.path("piece_bpe_32k.model"))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learned(docs)).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
