"""Token counts of whole texts by the whole-token shortcut.

Offline, once per vocabulary: every vocabulary string is run through the tokenizer's merges alone, and those that come out as
exactly one token are the *whole tokens* (a string of the vocabulary may still be split by the merges, as merges are not
skipped for known words). Also offline, the class (letter, number, space, other) of every code point under the tokenizer's
pre-tokenizer is compared with its class under the published split pattern in Python's ``regex``; the few that differ (the
two ship different Unicode versions) are *doubtful*.

At run time a text is cut where the tokenizer cuts it: at its added tokens (each counts one, as the library matches them in
text by default), then by the split pattern, or by the tokenizer's own pre-tokenizer where the text holds a doubtful code
point. A pre-token that is a whole token counts one without merging; only the rest is merged, each distinct piece once per
worker. The count equals the length of the library's ``encode(text, add_special_tokens=False)``.

The whole tokens are bounded by the vocabulary (50,257 strings for ``byte_bpe_50k.json``) and the doubtful code points by
Unicode, so both go with the task closure. Documents are counted where they are read; nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import table

#: A document is over the limit with more tokens than this.
LIMIT = 1024
#: Texts counted at once in a task.
BATCH = 256
#: Merged pre-tokens a worker remembers before it starts afresh.
MERGED = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings (in the pre-tokenizer's alphabet) that the merges leave as one token when they stand alone."""
    model = _tokenizer(path).model
    vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    return frozenset(v for v in vocab if len(model.tokenize(v)) == 1)


@cache
def added_tokens(path: str) -> tuple[str, ...]:
    """Contents of added tokens, longest first, as the library matches them in text by default."""
    added = json.load(open(path, encoding="utf-8")).get("added_tokens") or []
    return tuple(sorted({a["content"] for a in added if a.get("content")}, key=len, reverse=True))


def byte_alphabet() -> dict[int, str]:
    """The byte-level pre-tokenizer's character for each byte: printable Latin-1 bytes stand for themselves, the others
    take the characters from 256 on, in byte order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


@cache
def whole_surfaces(path: str) -> frozenset[str]:
    """The whole tokens as the text they stand for (those whose bytes are UTF-8)."""
    back = {c: b for b, c in byte_alphabet().items()}
    out = set()
    for v in whole_tokens(path):
        try:
            out.add(bytes(back[c] for c in v).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            pass
    return frozenset(out)


def _classes(split) -> list[str]:
    """Class of every code point as ``split`` sees it: letter, number, other mark or space (surrogates excluded)."""
    out = []
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000:
            out.append("-")
            continue
        c = chr(cp)
        out.append("L" if len(split(f"a{c}a")) == 1 else "N" if len(split(f"1{c}")) == 1 else "O" if len(split(f"!{c}")) == 1 else "S")
    return out


@cache
def doubtful(path: str) -> str:
    """Code points that the tokenizer's pre-tokenizer and ``PATTERN`` under Python's ``regex`` class apart, as a string.

    Proved once per vocabulary over all code points: where every character of a text has the same class in both, the
    pattern cuts the text alike (it looks at nothing but the classes and the ASCII contractions).
    """
    pre = _tokenizer(path).pre_tokenizer
    theirs = _classes(pre.pre_tokenize_str)
    ours = _classes(_pattern().findall)
    return "".join(chr(cp) for cp, (a, b) in enumerate(zip(theirs, ours, strict=True)) if a != b)


@cache
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


class Counter:
    """Counts tokens of texts with one tokenizer; merged pieces are remembered by the worker, up to ``MERGED`` of them.

    Texts are cut by ``PATTERN`` with Python's ``regex``, except texts holding a doubtful code point, which the tokenizer's
    own pre-tokenizer cuts.
    """

    def __init__(self, path: str, doubtful_chars: str):
        tok = _tokenizer(path)
        self.pre, self.model = tok.pre_tokenizer, tok.model
        self.whole, self.surfaces, self.added = whole_tokens(path), whole_surfaces(path), added_tokens(path)
        self.alphabet = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self.pattern = _pattern()
        self.doubt = frozenset(doubtful_chars)
        self.merged: dict[str, int] = {}

    def _segments(self, text: str) -> tuple[int, list[str]]:
        """Added tokens found (leftmost, longest first) and the text between them."""
        segments, found = [text], 0
        for a in self.added:
            cut = []
            for s in segments:
                parts = s.split(a)
                found += len(parts) - 1
                cut.extend(parts)
            segments = cut
        return found, [s for s in segments if s]

    def _merge(self, piece: str) -> int:
        """Tokens of one pre-token in the byte alphabet."""
        m = self.merged.get(piece)
        if m is None:
            if len(self.merged) >= MERGED:
                self.merged.clear()
            m = self.merged[piece] = len(self.model.tokenize(piece))
        return m

    def count(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            n, segments = self._segments(text)
            if not self.doubt.isdisjoint(text):
                for s in segments:
                    for piece, _ in self.pre.pre_tokenize_str(s):
                        n += 1 if piece in self.whole else self._merge(piece)
            else:
                surfaces, alphabet = self.surfaces, self.alphabet
                for s in segments:
                    pieces = self.pattern.findall(s)
                    rest = [q for q in pieces if q not in surfaces]
                    n += len(pieces) - len(rest)
                    for q in rest:
                        n += self._merge(q.encode("utf-8").decode("latin-1").translate(alphabet))
            out.append(n)
        return out


@cache
def _counter(path: str, doubtful_chars: str) -> Counter:
    """One per worker process."""
    return Counter(path, doubtful_chars)


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs`` (``doc_id, text``; other columns are ignored).

    A NULL or empty text has 0 bytes and 0 tokens; rows with a NULL id and repeated rows are counted like others, one output
    row each; texts of any length are counted whole; an empty table gives an empty result.
    """
    path = vocabulary or default_vocabulary()
    chars = doubtful(path)  # proved on the driver once, sent with the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, chars)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                counts = pa.array(counter.count(part.column(1).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), counts], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the byte length is taken in the JVM and passes the Python worker unchanged
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > F.lit(limit)).alias("over_limit"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
