"""Hard negatives, token counts and vector codes against brute-force versions, on odd inputs too."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import hard_negatives as H
from clickloom.llm import token_counts as T
from clickloom.llm import vector_codes as V
from clickloom.llm.common import table

from .conftest import ODD

SMALL = "/root/testdata/sf0.01"
EMB = "vec_id long, embedding array<float>, label int, code string, q int, rid string"


def vectors(seed, n, dim, labels=4, copies=20):
    """Rows with NULL, NaN and infinite vectors, NULL labels and ids, repeated rows and equal vectors under other ids."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) / np.sqrt(dim)
    rows = [(int(i), [float(v) for v in x[i]], int(rng.integers(labels)), "c", 1, "r") for i in range(n)]
    rows += [(n + i, rows[i][1], rows[i][2], "c", 1, "r") for i in range(copies)]  # equal vectors, other ids
    rows += [rows[3], rows[50]]  # repeated rows
    rows += [(n + 100, None, 1, "c", 1, "r"), (n + 101, [float("nan")] * dim, 1, "c", 1, "r"), (n + 102, [float("inf")] + [0.0] * (dim - 1), 1, "c", 1, "r")]
    rows += [(n + 103, [0.1] * dim, None, "c", 1, "r"), (n + 150, [0.0] * dim, 2, "c", 1, "r"), (None, [0.2] * dim, 1, "c", 1, "r")]
    return rows


def brute_negatives(rows):
    keep = [r for r in rows if r[2] is not None and r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])]
    ids = np.array([2**63 - 1 if r[0] is None else r[0] for r in keep])
    has_id = np.array([r[0] is not None for r in keep])
    lab = np.array([r[2] for r in keep])
    lab = np.where(has_id & (ids % 7 == 0), (lab + 1) % 10, lab)
    x = np.floor(np.array([r[1] for r in keep], np.float64) * 256).astype(np.int64)
    out = []
    for i in np.nonzero(has_id & (ids % 50 == 0))[0]:
        s = x @ x[i]
        same = np.nonzero((lab == lab[i]) & (np.arange(len(ids)) != i))[0]
        for p in same[np.lexsort((ids[same], -s[same]))][:5]:
            c = np.nonzero((lab != lab[i]) & (50 * s[p] <= 100 * s) & (100 * s <= 95 * s[p]))[0]
            for r, m in enumerate(c[np.lexsort((ids[c], -s[c]))][:3]):
                out.append((int(ids[i]), int(ids[p]), r + 1, int(ids[m]), int(s[p]), int(s[m])))
    return sorted(tuple(2**63 - 1 if v is None else v for v in r) for r in out)


def test_hilbert_index_is_a_bijection_that_keeps_neighbours_near():
    pts = np.array([[a, b] for a in range(8) for b in range(8)])
    h = H.hilbert_index(pts, 3)
    assert sorted(h) == list(range(64))
    path = pts[np.argsort(h)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("block", [8, 256])
def test_hard_negatives_equal_brute_force(spark, scratch, block):
    rows = vectors(1, 400, 6)
    df = spark.createDataFrame(rows, EMB).repartition(4)
    got = H.mine(df, scratch, block=block).collect()
    assert sorted(tuple(2**63 - 1 if v is None else v for v in r) for r in got) == brute_negatives(rows)
    assert len(got) > 20


def test_hard_negatives_of_nothing(spark, scratch):
    assert H.mine(spark.createDataFrame([], EMB), scratch).count() == 0
    only_nulls = spark.createDataFrame([(50, None, 1, "c", 1, "r"), (100, [1.0, 2.0], None, "c", 1, "r")], EMB)
    assert H.mine(only_nulls, scratch).count() == 0


def test_hard_negatives_on_the_test_table(spark):
    got = H.op11_hard_negatives(spark, SMALL)
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SMALL}/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in t]
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)


def test_token_counts_equal_the_library(spark, odd, none):
    tok = T._tokenizer(T.default_vocabulary())
    got = T.token_counts(odd).collect()
    want = [(i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert any(r.over_limit for r in got)
    assert T.token_counts(none).count() == 0


def test_token_counts_of_special_strings_and_odd_spaces():
    path = T.default_vocabulary()
    c, tok = T.Counter(path, T.doubtful(path)), T._tokenizer(path)
    texts = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext", "  a  b\t\t\n\n c", "\x1c\x1d 　x", "x" * 5000, "'s'S 're'VE"]
    # code points that Unicode versions class apart, one in each text
    texts += [f"a{d}{d}b {d}1 x{d}  {d}\n'{d}" for d in sorted(T.doubtful(path))[:: max(1, len(T.doubtful(path)) // 300)]]
    assert c.count(texts) == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_every_code_point_is_cut_as_the_tokenizer_cuts_it():
    path = T.default_vocabulary()
    c, tok = T.Counter(path, T.doubtful(path)), T._tokenizer(path)
    probe = [f"a{chr(cp)}{chr(cp)}b {chr(cp)}1 x{chr(cp)}  {chr(cp)}\n'{chr(cp)}" for cp in [*range(0xD800), *range(0xE000, 0x110000, 3)]]
    assert c.count(probe) == [len(e.ids) for e in tok.encode_batch(probe, add_special_tokens=False)]


def test_token_counts_on_the_test_table(spark):
    import pyarrow.parquet as pq

    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
    tok = T._tokenizer(T.default_vocabulary())
    got = {r.doc_id: r.n_tokens for r in T.op12_token_counts(spark, SMALL).collect()}
    assert got == {i: len(e.ids) for i, e in zip(texts, tok.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    keep = [r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])]
    keep.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0))
    x = np.floor(np.array([r[1] for r in keep], np.float64) * scale).astype(np.int64).reshape(len(keep), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        return d.argmin(-1), d.min(-1)

    for _ in range(rounds):
        c, _d = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (c[:, p] == e).any():
                    books[p, e] = x[c[:, p] == e, p].sum(0) // (c[:, p] == e).sum()
    c, d = assign()
    return [(r[0], "".join(f"{v:02x}" for v in cc), int(dd.sum())) for r, cc, dd in zip(keep, c, d, strict=True)], books


def test_vector_codes_equal_plain_lloyd(spark, scratch):
    rows = [r for r in vectors(2, 300, 16) if r[0] is None or r[0] != 150]
    df = spark.createDataFrame(rows, EMB).repartition(5)
    coded, books = V.compress(df, scratch)
    want, want_books = brute_codes(rows)
    got = sorted(((r.vec_id, r.code, r.error) for r in coded.collect()), key=lambda r: (r[0] is None, r))
    assert got == sorted(want, key=lambda r: (r[0] is None, r))
    assert (books == want_books).all()
    assert V.codebook_digest(books) == hashlib.sha256(",".join(str(int(v)) for v in want_books.ravel()).encode()).hexdigest()


def test_active_entries_equal_full_scans():
    rng = np.random.default_rng(3)
    x = rng.integers(-20, 20, size=(500, 4, 3))
    books = rng.integers(-20, 20, size=(4, 6, 3))
    codes, dist = V.assign(x, books, None, None, None)
    for _ in range(5):
        moved = rng.random((4, 6)) < 0.4
        books = np.where(moved[:, :, None], rng.integers(-20, 20, size=books.shape), books)
        fast = V.assign(x, books, codes, dist, moved)
        full = V.assign(x, books, None, None, None)
        assert (fast[0] == full[0]).all() and (fast[1] == full[1]).all()
        codes, dist = fast


def test_vector_codes_of_few_and_no_rows(spark, scratch):
    rows = [(i, [float(i)] * 8, None, "c", 1, "r") for i in range(3)]
    coded, books = V.compress(spark.createDataFrame(rows, EMB), scratch)
    assert books.shape == (8, 3, 1)
    assert sorted((r.vec_id, r.code, r.error) for r in coded.collect()) == [(0, "00" * 8, 0), (1, "01" * 8, 0), (2, "02" * 8, 0)]
    empty, books = V.compress(spark.createDataFrame([], EMB), scratch)
    assert empty.count() == 0 and books.size == 0


def test_vector_codes_query_on_the_test_table(spark):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SMALL}/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in t]
    want, books = brute_codes(rows)
    got = V.op13_vector_codes(spark, SMALL).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted(want)
    by_label = {}
    for r, (_, _, e) in zip(sorted(rows, key=lambda r: r[0]), sorted(want), strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    labels = {r[0]: r[2] for r in rows}
    assert all(r.label_error == by_label[labels[r.vec_id]] for r in got)
    assert {r.codebooks_sha256 for r in got} == {V.codebook_digest(books)}
    assert table(spark, SMALL, "embeddings").filter(F.col("embedding").isNotNull()).count() == len(got)
