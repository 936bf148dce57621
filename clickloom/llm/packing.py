"""Hierarchical multi-length packing of token sequences.

Documents are tokenised once; a document longer than the long window gives full windows and one rest. Every piece is routed
to the tier of the smallest context size that holds it. How pieces share windows is decided on the histogram of piece
lengths alone (at most ``WINDOW`` rows, whatever the corpus): a plan of patterns, each a list of lengths with a number of windows.

1. long tier: each window starts with its longest piece and its gap is filled from shorter tiers, exactly where a
   piece of that length is left, else with the longest that fits;
2. shorter tiers: windows that pieces fill exactly (their size is a power of two, so they need no padding);
3. what is left fills long windows by best fit.

Pieces then take their places by rank within their length, a prefix sum over (length, bucket) counts, so a length that a
third of all pieces share is ranked in many tasks. Windows of a tier are dealt to step groups of equal token count.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import Scratch, ranked, table

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
END = 1
#: Windows of the long tier in a training step; shorter tiers have as many tokens a step.
STEP_WINDOWS = 512
#: Ranks within a length are counted in so many parts.
BUCKETS = 256
#: Words kept by a worker; beyond that, those met in one batch only are forgotten.
CACHE = 600_000
#: Texts encoded at once: at most so many, and so many bytes of them unless one text alone is longer.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20
#: Words encoded as one text.
JOINED = 2000
MARKS = ".,;:!?"
#: Between NULs: a part with white space next to white space or at an end, but for one space before it; a line break is one.
_ODD = re.compile(r"\0(?!\n\0)(?:(?! )\s|[^\0]*\s(?:\s|\0))")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _byte_lengths(path: str) -> np.ndarray:
    """Bytes of text that each id of a byte-level vocabulary stands for: a character of the token for each."""
    vocab = _tokenizer(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token)
    return out


class Encoder:
    """Ids of whole texts as unsigned 32-bit numbers, a batch at a time.

    Where white space stands alone, the tokenizer's words end before a space and on both sides of a line break, and a mark
    after a letter is a word of its own. Such texts are cut there, the parts of a batch are counted once, and the ids of
    each different part are looked up, so only parts not met before are encoded; texts with white space next to white space
    are encoded whole. The ids of all known parts lie in one array, from which those of a batch are gathered.
    """

    def __init__(self, path: str, most: int = CACHE):
        self.path, self.most = path, most
        self._forget(np.zeros(0, np.int64))

    def _forget(self, keep: np.ndarray) -> None:
        """Only the known parts at the places ``keep`` (ascending) stay."""
        if len(keep):
            lengths = self.lengths[keep]
            flat = self._gather(self.starts[keep], lengths)
            kept = np.zeros(len(self.known), bool)
            kept[keep] = True
            words = [w for w, k in zip(self.known, kept.tolist(), strict=True) if k]
            self.starts, self.lengths, self.flat = np.cumsum(lengths) - lengths, lengths, flat
        else:
            # the empty part is at place 0
            words, self.starts, self.lengths, self.flat = [""], np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, "<u4")
        self.known: dict[str, int] = {w: i for i, w in enumerate(words)}  # the place of a part, in order of places
        self.met, self.odd = np.zeros(len(words), np.int64), set()

    def _gather(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        before = np.cumsum(lengths) - lengths
        return self.flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]

    def _ids(self, parts: list[str], lead: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of parts and the number of each, some thousand parts at once as one text, each behind ``lead``; parts of a
        text that does not fall apart again at its parts are encoded one by one."""
        tok, sizes = _tokenizer(self.path), _byte_lengths(self.path)
        flat, lengths = [], []
        for at in range(0, len(parts), JOINED):
            some = parts[at : at + JOINED]
            text = lead + lead.join(some)
            ids = np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(0, np.cumsum(sizes[ids]))
            plain = map(len, some) if text.isascii() else (len(w.encode()) for w in some)
            size = np.fromiter(plain, np.int64, len(some)) + len(lead)
            stop = np.cumsum(size)
            start = stop - size + len(lead)
            first, last = np.searchsorted(ends, start), np.searchsorted(ends, stop)
            if ends[-1] == stop[-1] and (ends[first] == start).all() and (ends[last] == stop).all():
                own = np.ones(len(ids), bool)
                if lead:
                    own[first - 1] = False
                flat.append(ids[own])
                lengths.append(last - first)
            else:
                each = [np.array(e.ids, "<u4") for e in tok.encode_batch_fast(some, add_special_tokens=False)]
                flat.extend(each)
                lengths.append(np.fromiter(map(len, each), np.int64, len(each)))
        return flat, lengths

    def _learn(self, parts: list[str]) -> None:
        known = self.known
        marked = [w for w in parts if w[-1] in MARKS and w[-2:-1].isalpha()]
        plain = dict.fromkeys(parts)
        for w in marked:
            del plain[w]
        plain.update(dict.fromkeys(w[:-1] for w in marked))
        plain.update(dict.fromkeys(MARKS))
        new = [w for w in plain if w not in known]
        # white space at an end or next to white space: a text with such a part is encoded whole
        bad = []
        if _ODD.search("\0" + "\0".join(new) + "\0"):
            bad = [w for w in new if _ODD.search(f"\0{w}\0")]
            new = [w for w in new if not _ODD.search(f"\0{w}\0")]
        # a part that begins with a space ends the word before it; the others are set off by a line break
        spaced, others = [w for w in new if w[0] == " "], [w for w in new if w[0] != " "]
        flat, lengths = [self.flat], [self.lengths]
        for some, lead in ((spaced, ""), (others, "\n")):
            ids, counts = self._ids(some, lead)
            flat += ids
            lengths += counts
        for w in (*spaced, *others):
            known[w] = len(known)
        self.flat, self.lengths = np.concatenate(flat), np.concatenate(lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        # a word with a mark: the ids of both in turn
        whole = [w for w in marked if w[:-1] in known and known[w[:-1]] >= 0]
        both = np.empty((len(whole), 2), np.int64)
        both[:, 0] = np.fromiter((known[w[:-1]] for w in whole), np.int64, len(whole))
        both[:, 1] = np.fromiter((known[w[-1]] for w in whole), np.int64, len(whole))
        more = self._gather(self.starts[both.ravel()], self.lengths[both.ravel()])
        for w in whole:
            known[w] = len(known)
        self.flat = np.append(self.flat, more)
        # the ids of a known part lie behind those of the part before it
        self.lengths = np.append(self.lengths, self.lengths[both].sum(1))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.odd.update(bad, (w for w in marked if w[:-1] in self.odd or w[:-1] in bad))
        self.met = np.append(self.met, np.zeros(len(known) - len(self.met), np.int64))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(counts)[:-1])] if len(texts) else []

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and the number of each; NULL is empty."""
        if len(self.known) + len(self.odd) > self.most:
            often = np.flatnonzero(self.met > 1)
            often = often[often > 0] if len(often) < self.most // 2 else often[:0]
            self._forget(np.append(0, often) if len(often) else often)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        alone = pc.invert(pc.or_(pc.match_substring(texts, "\0"), pc.or_(pc.match_substring(texts, "\n\n"), pc.match_substring(texts, "\n "))))
        cut = pc.if_else(alone, texts, "")
        cut = pc.replace_substring(pc.replace_substring(cut, " ", "\0 "), "\n", "\0\n\0")
        parts = pc.split_pattern(cut, "\0")
        bounds = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        # no part holds a NUL
        words = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary.cast(pa.string())), "\0")[0].as_py().split("\0")
        places = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(places < 0)
        if len(new):
            unknown = [words[i] for i in new.tolist()]
            self._learn([w for w in unknown if w not in self.odd])
            places[new] = np.fromiter(map(self.known.get, unknown, repeat(-1)), np.int64, len(unknown))
        # a part of white space that the tokenizer may join with its neighbours has no ids of its own
        known = np.maximum(places, 0)
        self.met[known] += 1
        indices = coded.indices.to_numpy()
        bad = np.append(0, np.cumsum(places[indices] < 0))
        place = known[indices]
        whole = ~alone.to_numpy(zero_copy_only=False) | (bad[bounds[1:]] > bad[bounds[:-1]])
        ids_before = np.append(0, np.cumsum(self.lengths[place]))
        counts = ids_before[bounds[1:]] - ids_before[bounds[:-1]]
        gathered = self._gather(self.starts[place], self.lengths[place])
        if not whole.any():
            return gathered, counts
        encoded = _tokenizer(self.path).encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)
        rest, out = iter([np.array(e.ids, "<u4") for e in encoded]), []
        for i, is_whole in enumerate(whole.tolist()):
            out.append(next(rest) if is_whole else gathered[ids_before[bounds[i]] : ids_before[bounds[i + 1]]])
        return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))


@cache
def _encoder(path: str) -> Encoder:
    """One per worker process, so that what it knows serves all its tasks."""
    return Encoder(path)


def _batches(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` of text (one row at least)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        done = int(sizes[at - 1]) if at else 0
        end = min(at + BATCH_ROWS, max(at + 1, int(np.searchsorted(sizes, done + BATCH_BYTES, "right"))))
        yield b.slice(at, end - at)
        at = end


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``) of every piece of every row; NULL text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for b in batches:
            for part in _batches(b, 1):
                ids, counts = encoder.encode_column(part.column(1))
                tokens = counts + 1
                ends = np.cumsum(tokens)
                # every document's ids and the end id behind them
                own = np.ones(int(ends[-1]), bool)
                own[ends - 1] = False
                stream = np.full(len(own), END, "<u4")
                stream[own] = ids
                pieces = -(-tokens // window)
                doc = np.repeat(np.arange(len(tokens)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(tokens[doc] - start, window)
                low = (ends - tokens)[doc] + start
                data = memoryview(stream).cast("B")
                cuts = [data[4 * i : 4 * (i + n)] for i, n in zip(low.tolist(), length.tolist(), strict=True)]
                columns = [
                    part.column(0).take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array(list(map(zlib.crc32, cuts)), pa.int64()), pa.array(tokens[doc], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([c.tobytes() for c in cuts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


class Histogram:
    """Counts of piece lengths with the longest length left at or below a bound."""

    def __init__(self, counts: dict[int, int], window: int):
        self.n = np.zeros(window + 1, np.int64)
        for length, count in counts.items():
            self.n[length] = count

    def longest(self, at_most: int) -> int:
        left = np.flatnonzero(self.n[1 : at_most + 1])
        return int(left[-1]) + 1 if len(left) else 0

    def take(self, pattern: list[int]) -> int:
        """Removes the pattern as often as it is there and tells how often."""
        lengths, each = np.unique(pattern, return_counts=True)
        times = int((self.n[lengths] // each).min())
        self.n[lengths] -= times * each
        return times

    def filled(self, pattern: list[int], size: int) -> list[int]:
        """The pattern and, longest first, what fits into its gap."""
        pattern, left = list(pattern), self.n.copy()
        for p in pattern:
            left[p] -= 1
        gap = size - sum(pattern)
        while gap:
            fits = np.flatnonzero(left[1 : gap + 1] > 0)
            if not len(fits):
                break
            best = int(fits[-1]) + 1
            # two pieces that close the gap exactly beat the longest piece that does not
            if best < gap:
                a = fits + 1
                b = gap - a
                exact = a[(b >= a) & (left[np.maximum(b, 0)] > (a == b))]
                if len(exact):
                    pattern += [int(gap - exact[-1]), int(exact[-1])]
                    break
            pattern.append(best)
            left[best] -= 1
            gap -= best
        return pattern


def plan(counts: dict[int, int], window: int = WINDOW, tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, list[int]]]:
    """Patterns ``(tier, windows, lengths)``; each takes the last piece of one length, so they are few."""
    left, out = Histogram(counts, window), []

    def emit(tier: int, pattern: list[int]) -> None:
        out.append((tier, left.take(pattern), pattern))

    below = max((t for t in tiers if t < window), default=0)
    while (first := left.longest(window)) > below:
        emit(window, left.filled([first], window))
    for tier in sorted((t for t in tiers if t < window), reverse=True):
        shorter = max((t for t in tiers if t < tier), default=0)
        for first in range(tier, shorter, -1):
            while left.n[first]:
                pattern = left.filled([first], tier)
                if sum(pattern) < tier:
                    break
                emit(tier, pattern)
    while first := left.longest(window):
        emit(window, left.filled([first], window))
    return out


def placed(pieces: DataFrame, scratch: Scratch, window: int = WINDOW, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Adds ``sequence_id, offset, tier, step_group`` to pieces; ``pieces`` must be a saved table."""
    spark = pieces.sparkSession
    if window not in tiers or any(t & (t - 1) for t in tiers if t != window):
        raise ValueError("tiers must contain the window; shorter ones must be powers of two")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``window`` rows
    slots, sequence, taken, bases = [], 0, {}, {}
    for tier, windows, pattern in plan(counts, window, tiers):
        bases.setdefault(tier, 0)
        offset = 0
        for length in pattern:
            low = taken.get(length, 0)
            slots.append((length, low, low + windows, sequence, offset, tier, bases[tier]))
            taken[length] = low + windows
            offset += length
        sequence += windows
        bases[tier] += windows
    schema = "slot_length long, low long, high long, first_sequence long, offset long, tier long, first_in_tier long"
    slot_table = F.broadcast(spark.createDataFrame(slots, schema))  # rows: some per different length

    pieces_ranked = ranked(pieces, "length", ["doc_id", "start", "ids_crc32"], "rank", BUCKETS)
    out = pieces_ranked.join(slot_table, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    in_tier = F.col("first_in_tier") + F.col("rank") - F.col("low")
    return out.select(
        *pieces.columns,
        (F.col("first_sequence") + F.col("rank") - F.col("low")).alias("sequence_id"),
        "offset",
        "tier",
        F.floor(in_tier * F.col("tier") / F.lit(STEP_WINDOWS * window)).cast("long").alias("step_group"),
    )


def pack(docs: DataFrame, scratch: Scratch, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group`` (``ids``).

    Rows with a NULL id and repeated rows are packed like others; an empty table packs to nothing.
    """
    pieces = scratch.save(token_pieces(docs, tokenizer_path or default_tokenizer(), with_ids=with_ids), "pieces")
    return placed(pieces, scratch)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), Scratch(spark, "op8"))
