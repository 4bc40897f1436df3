"""A shard's search for many queries at once against scoring everything, and the names of terms."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import search
from tickloom.llm.common import buffers


def corpus(seed: int):
    """Documents in four languages that share some terms: lengths from 1 to some thousands, some twice, one without terms."""
    rng = np.random.default_rng(seed)
    docs = []
    for i in range(900):
        words = (rng.zipf(1.3, int(rng.integers(1, 60)) if i % 50 else 4000) % 3000) * 5 + (i % 4 + 1)
        docs.append(np.concatenate([words, words[::7] // 5 * 5]))
    docs += [docs[i] for i in range(0, 900, 9)] + [np.empty(0, np.int64)]
    terms, times = zip(*(np.unique(d, return_counts=True) for d in docs), strict=True)
    ids = rng.permutation(len(docs)).astype(np.int64)
    return ids, np.array([len(d) for d in docs]), np.array([len(t) for t in terms]), np.concatenate(terms).astype(np.int64), np.concatenate(times).astype(np.uint32)


@pytest.mark.parametrize("small", [False, True])
def test_many_queries_of_a_shard_equal_scoring_everything(monkeypatch, small):
    monkeypatch.setattr(search, "LEAST", 32)
    if small:
        for name, value in (("BLOCK", 40), ("HELD", 3000), ("HELD_POSTINGS", 2000), ("HELD_ENTRIES", 500), ("MOST_COMMON", 30), ("FIRST", 1), ("TERMS", (3, 9))):
            monkeypatch.setattr(search, name, value)
    ids, lengths, sizes, terms, times = corpus(5)
    n, mean, starts = len(ids), lengths.mean(), np.cumsum(sizes) - sizes
    names, at, df = np.unique(terms, return_inverse=True, return_counts=True)
    weight = np.log(1 + (n - df + 0.5) / (df + 0.5))
    doc = np.repeat(np.arange(n), sizes)
    part = times.astype(float)
    units = np.floor(weight[at] * (part * 2.2 / (part + 1.2 * (0.25 + 0.75 * lengths[doc] / mean))) * 1_000_000 + 0.5)
    queries = np.arange(0, n, 3)
    wanted = [np.arange(starts[q], starts[q] + sizes[q]) for q in queries]
    asked = np.concatenate([at[w] for w in wanted]).astype(np.int32)
    ends = np.cumsum([len(w) for w in wanted])
    want, bars = [], np.ones(len(queries), np.int64)
    for i, w in enumerate(wanted):
        mine = np.isin(at, at[w])
        score = np.bincount(doc[mine], units[mine], n)
        best = np.lexsort((ids, -score))[:10]
        best = best[score[best] > 0]
        want += [(i, int(ids[d]), int(score[d])) for d in best]
        if len(best) == 10:
            bars[i] = score[best[-1]]
    shard = search.Shard(search._joined(search._sliced(search.inverted(ids, lengths, sizes, terms, times))), mean, names, weight)
    assert len(shard.edges) > 3
    counted, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **b: counted.append(1) or bincount(*a, **b))
    for bar in (np.ones(len(queries), np.int64), bars, bars + 1):
        counted.clear()
        got = list(zip(*(x.tolist() for x in shard.top(asked, ends, bar, 10)), strict=True))
        assert got == [w for w in want if w[2] >= bar[w[0]]]
        # queries go together: less than one sum for each of them
        assert small or len(counted) < len(queries)
    names_of_others = names + 10**6
    assert [len(x) for x in search.Shard(search.inverted(ids, lengths, sizes, terms, times), mean, names_of_others, weight).top(asked, ends, bars, 10)] == [0, 0, 0]


def test_names_of_terms():
    texts = ["", "a", "A a", "ab", "cd", "é É1", "", "a\x00b", " x\n", "12345678 123456789 12345678x", "x" * 64 + " " + "X" * 65, "x" * 65 + "y", "x" * 66, "ab-CD"]
    offsets, data = buffers(pa.array(texts))
    names, bounds = search._names(data[offsets[0] : offsets[-1]], offsets)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.translate(lower)) for t in texts]
    assert np.diff(bounds).tolist() == [len(t) for t in terms]
    flat = [x for t in terms for x in t]
    assert len(set(zip(flat, names.tolist(), strict=True))) == len(set(flat)) == len(set(names.tolist()))
    assert [len(x) for x in search._names(np.empty(0, np.uint8), np.zeros(3, np.int64))] == [0, 3]
