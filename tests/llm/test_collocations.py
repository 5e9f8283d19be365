import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_data import ODD

from lurescan.llm import collocations


def brute(rows, max_words=3, min_count=10, drop_percent=50, top=2000):
    """{(lang, rank): (phrase, a, l, r, n, score)} in plain Python integers."""
    grams, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    grams.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    out = {}
    for lang, f in grams.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        dropped = {q for p, b in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
                   if 100 * b >= drop_percent * f[q := p[i:i + k]]}
        found = []
        for p, a in cand.items():
            if p not in dropped:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out[lang, rank] = (phrase.decode(), -a, l, r, totals[lang], -s)
    return out


def got(df):
    rows = df.collect()
    out = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows}
    assert len(out) == len(rows)
    return out


def test_documents(spark, documents):
    rows = [(r.lang, r.text) for r in documents.collect()]
    assert got(collocations.mine(documents)) == brute(rows)
    assert got(collocations.mine(documents, min_count=4, top=7)) == brute(rows, min_count=4, top=7)


def test_small_chunks_and_longer_phrases(spark, documents, monkeypatch):
    """Texts cut between pieces, many chunks, and phrases of up to five words."""
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(collocations, "WAITING_BYTES", 5000)
    rows = [(r.lang, r.text) for r in documents.collect()]
    assert got(collocations.mine(documents, max_words=5, min_count=3)) == brute(rows, max_words=5, min_count=3)


def test_odd_texts(spark, odd, empty):
    rows = [("en" if i % 2 else None, t) for i, t in ODD]
    assert got(collocations.mine(odd, min_count=1)) == brute(rows, min_count=1)
    assert collocations.mine(empty, min_count=1).count() == 0
    twice = odd.unionByName(odd)
    assert got(collocations.mine(twice, min_count=2)) == brute(rows * 2, min_count=2)


def test_large_counts_and_hot_words(spark):
    """Ties, repeats and a phrase within a phrase at exactly half of its count."""
    rows = [("x", "a a a a, b c d. B C D\tb c")] * 7 + [(None, "b c d e " * 50), ("und", "b c"), ("x", None), ("y", "é ß ü é ß")]
    df = spark.createDataFrame(rows, "lang string, text string")
    for least in (1, 2, 7, 14):
        assert got(collocations.mine(df, min_count=least)) == brute(rows, min_count=least)


@pytest.mark.parametrize("width", [3, 2000, 5_000_000])
def test_tiles_equal_sorted_counts(width):
    rng = np.random.default_rng(width)
    left = np.concatenate([rng.integers(0, width, 50_000), rng.integers(0, min(width, 40), 200_000)])
    right = np.concatenate([rng.integers(0, width, 50_000), rng.integers(0, min(width, 40), 200_000)])
    pair, n = collocations.count_pairs(left, right)
    keys, want = np.unique(left << 32 | right, return_counts=True)
    order = np.argsort(pair)
    assert (pair[order] == keys).all() and (n[order] == want).all()
    assert len(collocations.count_pairs(left[:0], right[:0])[0]) == 0


def test_cut_texts_keep_their_words(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 40)
    rng = random.Random(1)
    for _ in range(200):
        texts = ["".join(rng.choice("ab  .\n") for _ in range(rng.choice([0, 5, 90, 200]))).encode() for _ in range(4)]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        data = np.frombuffer(b"".join(texts), np.uint8)

        def pieces(pairs):
            out = []
            for words, fresh in pairs:
                for w, new in zip(words.to_pylist(), fresh.tolist()):
                    out.append([w]) if new else out[-1].append(w)
            return out

        whole = pieces([collocations.words_of(offsets, data)])
        assert pieces(collocations.words_of(o, d) for o, d in collocations.parts(offsets, data)) == whole
