"""Line dedup, SimHash and decontamination against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from clickloom.llm import decontaminate as D
from clickloom.llm import line_dedup as L
from clickloom.llm import simhash as H

from tests.llm.conftest import LONG, ODD, SHARED

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                docs[key(line)].add(i)
    last = {k: max(ids) for k, ids in docs.items() if len(ids) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or last.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(spark, odd, none, tables):
    got = L.op1_line_dedup(spark, tables(documents=odd))
    assert sorted(map(tuple, got.collect()), key=str) == brute_lines(ODD)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def test_a_batch_writes_one_run_and_the_settled_run(odd, scratch, monkeypatch):
    written, write = [], L.LineRuns._write
    monkeypatch.setattr(L.LineRuns, "_write", lambda self, df: written.append(write(self, df)) or written[-1])
    L.repeated_lines(odd, scratch, batches=4)
    # compacted levels are not written before they are merged on: the first batch has nothing to settle
    assert len(written) == 7


def test_line_dedup_rewrites_text_only(odd, none, scratch):
    out = L.dedup_lines(odd, scratch)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert [r["text"] for r in out.filter("doc_id = 1").collect()] == [None]
    kept = [r["doc_id"] for r in out.filter(f"text like '%{SHARED}%'").collect()]
    assert kept == [202]
    assert L.dedup_lines(none, scratch).count() == 0


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_runs_do_not_depend_on_batches(odd, scratch, batches):
    found = L.repeated_lines(odd, scratch, batches=batches).collect()
    assert {r["doc_id"]: len(r["dropped"]) for r in found} == {**{100 + i: 1 for i in range(12)}, 200: 1, 201: 1}


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in ones.items() if 2 * n > len(shingles))


def test_simhash(spark, odd, none, scratch, tables):
    got = [tuple(r) for r in H.op4_simhash_near_dedup(spark, tables(documents=odd)).collect()]
    prints = [(i, brute_print(t)) for i, t in ODD]
    label = list(range(len(prints)))
    for _ in prints:  # labels spread until nothing changes
        for a, (_, x) in enumerate(prints):
            for b, (_, y) in enumerate(prints):
                if (x ^ y).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    least = defaultdict(list)
    for k, (i, _) in zip(label, prints):
        least[k] += [i] if i is not None else []
    want = [(i, f"{p:016x}", min(least[k], default=None)) for k, (i, p) in zip(label, prints)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert H.near_duplicates(none, scratch).count() == 0


def test_every_close_pair_meets():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = np.array([(1 << int(a)) | (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))], np.uint64)
    row, anchor, excess = H.anchors(base.view(np.int64))
    row2, anchor2, _ = H.anchors((base ^ flips).view(np.int64))
    home = dict(zip(row[excess == 0].tolist(), anchor[excess == 0].tolist()))
    visited = set(zip(row2.tolist(), anchor2.tolist()))
    assert len(home) == 300 and all((i, a) in visited for i, a in home.items())


def test_links_and_components_of_a_dense_group_and_a_chain(spark, scratch):
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(-(2**62), 2**62, 200)}
    base = 0x0123456789ABCDEF
    fps |= {base ^ (1 << i) for i in range(60)}  # a dense group
    chain = [0x7000000000000000 | (1 << (2 * i)) - 1 for i in range(25)]  # neighbours two bits apart
    fps |= set(chain)
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = H.links(nodes)
    got = {(r["a"], r["b"]) for r in edges.collect()}
    every = sorted(fps)
    want = {(a, b) for k, a in enumerate(every) for b in every[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want
    found = {r["node"]: r["component"] for r in H.components(edges, scratch).collect()}
    assert {found[c] for c in chain} == {min(chain)}


def test_drop_near_duplicates_keeps_one_of_each_group(odd, none, scratch):
    out = H.drop_near_duplicates(odd, scratch)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == odd.columns
    assert ids.count(4) == 1 and 5 not in ids and None not in ids and 2 not in ids and 3 not in ids and 1 in ids
    assert H.drop_near_duplicates(none, scratch).count() == 0


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def brute_hits(docs, bench):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    grams = defaultdict(set)
    for item, t in bench:
        w = words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[i : i + n])].add(item)
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    items |= grams[tuple(w[i : i + n])]
        names = ",".join(sorted(str(i) for i in items if i is not None))
        named = [i for i in items if i is not None]
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination(spark, odd, none, scratch, tables):
    bench = [(1, PASSAGE), (10, "Short-Item, one!"), (2, PASSAGE.upper() + " more"), (None, "end"), (3, None), (4, "..."), (5, "日本語")]
    extra = [(300, f"before {PASSAGE} after"), (301, "x " * 400 + PASSAGE.replace(" ", ", ")), (302, "a short item one b " * 3), (303, PASSAGE[:60])]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    got = D.op10_benchmark_decontamination(spark, tables(documents=docs, benchmark=benchmark))
    assert sorted(map(tuple, got.collect()), key=str) == brute_hits([*ODD, *extra], bench)
    kept = D.decontaminate(docs, benchmark, scratch)
    assert not {300, 302} & {r["doc_id"] for r in kept.collect()} and {301, 303, 6} <= {r["doc_id"] for r in kept.collect()}
    cut = {r["doc_id"]: r["text"] for r in D.remove_spans(docs, benchmark, scratch).collect()}
    assert cut[300] == "before after" and cut[6] == LONG
    nothing = spark.createDataFrame([], benchmark.schema)
    assert D.decontaminate(odd, nothing, scratch).count() == odd.count() and D.decontaminate(none, benchmark, scratch).count() == 0
