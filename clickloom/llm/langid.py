"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Each language has a probability for every piece, learned by expectation
maximisation over all ways to segment its words. A text is scored by the forward algorithm: the probability of a
word in a language is the sum over all its segmentations, the text's is the product over its words. Words repeat, so
each different word of a batch is summed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import Scratch, first_by_hash, fold, table

#: Documents learned from, per language, in hash order of the id.
PER_LANGUAGE = 1000
ROUNDS = 3
#: A longer run of visible characters is scored in blocks of so many.
WORD = 31
LONGEST = 16
#: Probability of a character that the vocabulary lacks, and the count added to every piece.
UNKNOWN, ADDED = 1e-7, 0.02
FOLDS, HELD_OUT = 5, 0
#: Words whose sums a worker keeps.
CACHE = 300_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_START = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces found by the hash of their code points; ids follow the vocabulary file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        pieces = [model.id_to_piece(i) for i in kept]
        self.size = model.get_piece_size()  # one more slot stands for unknown characters
        h = np.array([self.hash(p) for p in pieces if len(p) <= LONGEST], np.uint64)
        ids = np.array([i for i, p in zip(kept, pieces, strict=True) if len(p) <= LONGEST])
        order = np.argsort(h)
        self.hashes, self.ids = h[order], ids[order]
        self.seen = np.zeros(1 << 18, bool)
        self.seen[self.hashes >> np.uint64(46)] = True

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_MULTIPLIER) + ord(c) + 1) & (2**64 - 1)
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashed substrings, -1 for none."""
        out = np.full(h.shape, -1, np.int32)
        maybe = self.seen[h >> np.uint64(46)]
        some = h[maybe]
        at = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
        out[maybe] = np.where(self.hashes[at] == some, self.ids[at], -1)
        return out

    def substrings(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Lengths, and for n = 1, 2, ... the piece that starts at each place with n characters (-1: none)."""
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max())
        codes = np.zeros((len(words), width), np.uint64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.arange(width) < lengths[:, None]
        codes[inside] = flat + np.uint64(1)
        h, found = codes, []
        for n in range(1, min(width, LONGEST) + 1):
            if n > 1:
                h = h[:, :-1] * _MULTIPLIER + codes[:, n - 1 :]
            ids = self.find(h)
            ids[~inside[:, n - 1 :]] = -1
            if n == 1:
                ids[inside & (ids < 0)] = self.size
            found.append(ids)
        return lengths, found


@cache
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def words_of(text: str | None) -> list[str]:
    """Lower-cased words with the start mark; long ones in blocks."""
    out = []
    for w in (text or "").lower().split():
        w = _START + w
        out.extend([w] if len(w) <= WORD + 1 else [w[i : i + WORD + 1] for i in range(0, len(w), WORD + 1)])
    return out


def forward(found: list[np.ndarray], width: int, p: np.ndarray, pick: np.ndarray | None = None) -> np.ndarray:
    """Sums over the segmentations of each prefix. ``p``: pieces x languages; ``pick``: one language per word."""
    rows = found[0].shape[0]
    alpha = np.zeros((rows, width + 1, *(() if pick is not None else (p.shape[1],))))
    alpha[:, 0] = 1
    for end in range(1, width + 1):
        for n in range(1, min(end, len(found)) + 1):
            ids = found[n - 1][:, end - n]
            at = np.flatnonzero(ids >= 0)
            if len(at):
                q = p[ids[at]] if pick is None else p[ids[at], pick[at]]
                alpha[at, end] += alpha[at, end - n] * q
    return alpha


def word_scores(vocabulary: Vocabulary, words: list[str], p: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language."""
    out = np.zeros((len(words), p.shape[1]))
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    for at in range(0, len(order), 4096):
        part = order[at : at + 4096]
        n, found = vocabulary.substrings([words[i] for i in part])
        alpha = forward(found, int(n.max()), p)
        out[part] = np.log(alpha[np.arange(len(part)), n])
    return out


def expected_counts(vocabulary: Vocabulary, words: list[str], langs: np.ndarray, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in each language, over all segmentations."""
    total = np.zeros(p.size)
    order = np.argsort([len(w) for w in words], kind="stable")
    for at in range(0, len(order), 4096):
        part = order[at : at + 4096]
        n, found = vocabulary.substrings([words[i] for i in part])
        lang, width = langs[part], int(n.max())
        alpha = forward(found, width, p, lang)
        beta = np.zeros((len(part), width + 1))
        beta[np.arange(len(part)), n] = 1
        scale = counts[part] / alpha[np.arange(len(part)), n]
        for start in range(width - 1, -1, -1):
            for m in range(1, min(width - start, len(found)) + 1):
                ids = found[m - 1][:, start]
                use = np.flatnonzero(ids >= 0)
                if not len(use):
                    continue
                flow = p[ids[use], lang[use]] * beta[use, start + m]
                beta[use, start] += flow
                total += np.bincount(ids[use] * p.shape[1] + lang[use], alpha[use, start] * flow * scale[use], p.size)
    return total.reshape(p.shape)


class Model:
    def __init__(self, path: str, languages: list[str], p: np.ndarray, prior: np.ndarray):
        self.path, self.languages, self.p, self.prior = path, languages, p, prior
        self.index: dict[str, int] = {}

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Most likely language and its posterior; ``und`` with 0 where there is no letter or nothing was learned."""
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        vocabulary, out = _vocabulary(self.path), []
        if len(self.index) > CACHE or not self.index:
            self.index, self.scores = {"": 0}, np.zeros((1, len(self.languages)))
        split = [words_of(t) for t in texts]
        index = self.index
        rows = [[index.setdefault(w, len(index)) for w in ws] for ws in split]
        if len(index) > len(self.scores):
            new = list(index)[len(self.scores) :]
            self.scores = np.concatenate([self.scores, word_scores(vocabulary, new, self.p)])
        for text, at in zip(texts, rows, strict=True):
            if not any(map(str.isalpha, text or "")):
                out.append(("und", 0.0))
                continue
            z = self.prior + self.scores[at].sum(0)
            best = int(z.argmax())
            out.append((self.languages[best], float(1 / np.exp(z - z[best]).sum())))
        return out


def fit(docs: DataFrame, scratch: Scratch, learn_from: Column | None = None, vocabulary: str | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """Piece probabilities of every non-NULL language among the rows that satisfy ``learn_from``."""
    path = vocabulary or default_vocabulary()
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if learn_from is None else learn_from))
    ids = known.select("doc_id", "lang")
    share = {r[0]: r[1] for r in ids.groupBy("lang").count().collect()}
    languages = sorted(share)
    chosen = first_by_hash(ids.distinct(), "lang", "doc_id", per_language)
    chosen = F.broadcast(chosen.select("doc_id", "lang"))  # at most per_language rows a language
    sample = known.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, part in b.groupby("lang"):
                for at in range(0, len(part), 64):
                    found = pd.Series([w for t in part["text"].iloc[at : at + 64] for w in words_of(t)], dtype=object).value_counts()
                    yield pd.DataFrame({"lang": lang, "word": found.index.astype(str), "n": found.to_numpy()})

    words = sample.select("lang", "text").mapInPandas(count, "lang string, word string, n long")
    words = scratch.save(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    size, width = _vocabulary(path).size + 1, len(languages)
    p = np.full((size, width), 1.0 / size)
    p[-1] = UNKNOWN
    for _ in range(ROUNDS if languages else 0):

        def expect(batches: Iterator[pd.DataFrame], p: np.ndarray = p) -> Iterator[pd.DataFrame]:
            total = np.zeros(p.shape)
            for b in batches:
                lang = b["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
                total += expected_counts(_vocabulary(path), b["word"].tolist(), lang, b["n"].to_numpy(float), p)
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        # sums come back: at most pieces x languages
        got = words.mapInPandas(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        e = np.full(p.shape, ADDED)
        np.add.at(e, (got["piece"].to_numpy(int), got["lang"].to_numpy(int)), got["n"].to_numpy(float))
        p = e / e[:-1].sum(0)
        p[-1] = UNKNOWN
    total = np.array([share[x] for x in languages], float)
    return Model(path, languages, p, np.log(total / total.sum()) if languages else total)


def identify(docs: DataFrame, scratch: Scratch, learn_from: Column | None = None, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs``, from its whole text.

    ``und`` and 0 for NULL, empty and letterless texts, and for all texts if nothing could be learned. Repeated rows and
    rows with a NULL id are predicted like others.
    """
    model = fit(docs, scratch, learn_from, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = model.predict(part.column(1).to_pylist())
                columns = [part.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def learning_rows() -> Column:
    return fold(F.col("doc_id"), FOLDS) != HELD_OUT


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(table(spark, sf_dir, "documents"), Scratch(spark, "op3"), learning_rows())
    return out.select("doc_id", (~learning_rows()).alias("held_out"), "lang_pred", "score")
