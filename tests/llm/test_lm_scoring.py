"""Scores against a plain three-gram model, the trie against a dictionary, and the coded numbers by themselves."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlens.llm import elias_fano, lm_scoring, ngram_trie
from auditlens.llm.lm_scoring import discount, not_every_tenth, score_texts
from auditlens.llm.queries import op12
from tests.llm import brute
from tests.llm.conftest import FOLDER


def tokens(text):
    return [*brute.words("".join(c.lower() if c.isascii() else c for c in text or "")), None]


def model(rows):
    """{row number: (held_out, n, known, total, base, score)} of rows (learns, text), without quantising."""
    uni, two, three = Counter(), Counter(), Counter()
    for learns, text in rows:
        if learns:
            t = tokens(text)
            uni.update(t)
            two.update(zip(["<s>", *t], t))
            three.update(zip(["<s>", *t], t, t[1:]))
    after, after2 = {}, {}
    for (a, _), n in two.items():
        after.setdefault(a, []).append(n)
    for (a, b, _), n in three.items():
        after2.setdefault((a, b), []).append(n)
    d = [discount(*(sum(x == k for x in c.values()) for k in (1, 2))) for c in (two, three)]
    total = sum(uni.values())
    out = []
    for learns, text in rows:
        t, base, score = tokens(text), 0.0, 0.0
        for i, w in enumerate(t):
            single = (uni[w] + 0.1) / (total + 0.1 * (len(uni) + 1))
            base += math.log10(single)
            u, v = (["<s>", *t][i - 1] if i else None), ["<s>", *t][i]
            p = single
            if v in after:
                p = (max(two[v, w] - d[0], 0) + d[0] * len(after[v]) * p) / sum(after[v])
            if i and (u, v) in after2:
                p = (max(three[u, v, w] - d[1], 0) + d[1] * len(after2[u, v]) * p) / sum(after2[u, v])
            score += math.log10(p)
        out.append((not learns, len(t), sum(uni[w] > 0 for w in t), total, base, score))
    return out


def compare(result, expected):
    """The counts are equal, base scores up to rounding, scores up to half a step a factor."""
    assert len(result) == len(expected)
    worst = 0.5 / ngram_trie.STEPS * 3
    for got, want in zip(result, expected, strict=True):
        assert tuple(got[:4]) == want[:4]
        assert got[4] == pytest.approx(want[4], rel=1e-9, abs=1e-9)
        assert abs(got[5] - want[5]) <= worst * want[1] + 1e-9
    return [(g[5] - w[5]) / w[1] for g, w in zip(result, expected, strict=True)]


def held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def test_query_equals_plain_model(spark, given):
    docs = {r["doc_id"]: r["text"] for r in given.collect()}
    ids = sorted(docs)
    result = {r["doc_id"]: tuple(r)[1:] for r in op12(spark, FOLDER).collect()}
    assert sorted(result) == ids
    errors = compare([result[i] for i in ids], model([(not held(i), docs[i]) for i in ids]))
    assert abs(np.mean(errors)) < 0.01
    # Held-out texts are more likely by the model than by single words.
    out = [result[i] for i in ids if held(i)]
    assert sum(r[5] for r in out) > sum(r[4] for r in out)


@pytest.mark.parametrize(("block_bytes", "shard_bytes"), [(1, 1 << 21), (1 << 23, 900), (500, 3000)])
def test_hard_texts(spark, hard, block_bytes, shard_bytes):
    """Any cut into blocks and shards gives the same; words more frequent than a shard are dealt over several."""
    docs = hard.unionAll(hard.where("doc_id > 12")).withColumn("a.b", F.lit(1)).withColumn("shard", F.lit(1))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = sorted(zip([i for i, _ in rows], model([(i % 3 > 0, t) for i, t in rows])), key=str)
    result = score_texts(docs, F.col("doc_id") % 3 > 0, block_bytes=block_bytes, shard_bytes=shard_bytes)
    result = sorted(((r["doc_id"], tuple(r)[1:]) for r in result.collect()), key=str)
    assert [i for i, _ in result] == [i for i, _ in expected]
    compare([r for _, r in result], [r for _, r in expected])


def test_null_ids_are_learned_from(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    result = sorted((tuple(r) for r in score_texts(docs, not_every_tenth()).collect()), key=str)
    assert [r[1:4] for r in result] == [(False, 1, 1), (False, 3, 3), (False, 3, 3)]


def test_tries_can_be_kept(spark, hard):
    """The model is a table of tries, whose entries are those of the texts."""
    rows = lm_scoring.train_tries(hard, shard_bytes=2000).collect()
    two = {p for t in hard.collect() for p in zip(["<s>", *tokens(t["text"])], tokens(t["text"]))}
    assert len(rows) > 3
    assert sum(ngram_trie.Trie(bytes(r["body"])).next2.n for r in rows) == len(two)


def test_nothing_to_learn_from(spark, hard, empty):
    assert score_texts(empty, F.lit(True)).collect() == []
    rows = score_texts(hard, F.lit(None).cast("boolean")).collect()
    assert len(rows) == hard.count()
    assert all((r["held_out"], r["n_known"], r["train_tokens"], r["score"], r["base_score"]) == (True, 0, 0, 0, 0) for r in rows)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000, 5000])
@pytest.mark.parametrize("largest", [1, 700, 1 << 20, 1 << 45])
def test_coded_numbers(n, largest):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, largest, n))
    ef = elias_fano.EliasFano("x", elias_fano.views(elias_fano.flat(elias_fano.encode("x", values))))
    assert (ef[np.arange(n)] == values).all() and (ef.decoded().values == values).all()
    asked = np.concatenate([values, values + 1, rng.integers(0, 2 * largest, 300)])
    none = np.zeros(len(asked), dtype=np.int64)
    assert (ef.successor(asked, none, none + n) == np.searchsorted(values, asked)).all()


def test_coded_numbers_are_small():
    values = np.sort(np.random.default_rng(5).integers(0, 1 << 30, 1 << 17))
    size = sum(a.nbytes for a in elias_fano.encode("x", values).values())
    assert size * 8 / len(values) < 2 + 13 + 1


def test_trie_in_a_mapped_file(tmp_path):
    """Every entry is found, everything else is not, in a file that is mapped and not read."""
    rng = np.random.default_rng(7)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (300, 2))})
    words = np.arange(0, 45, dtype=np.int64)  # some contexts without successors
    triples = sorted({(int(p), int(w)) for p, w in zip(rng.integers(0, len(pairs), 900), rng.integers(0, 40, 900))})
    one, two = (np.array(x, dtype=np.int64) for x in zip(*pairs))
    at, three = (np.array(x, dtype=np.int64) for x in zip(*triples))
    n2, n3 = rng.integers(1, 9, len(pairs)), rng.integers(1, 9, len(triples))
    total = np.maximum(1, np.bincount(one, weights=n2, minlength=45)).astype(np.int64)
    kinds = np.maximum(1, np.bincount(one, minlength=45))
    path = tmp_path / "shard"
    path.write_bytes(ngram_trie.build((words, kinds, total), (one, two, n2), (at, three, n3), (0.5, 0.7)))
    trie = ngram_trie.Trie(np.memmap(path, np.uint8, "r"))
    a, b = (x.ravel().astype(np.int64) for x in np.meshgrid(np.arange(50), np.arange(50)))
    own2, rest2, rest3, own3 = trie.query(a, b, np.arange(2500).repeat(50), np.tile(np.arange(50), 2500))
    written_out = ngram_trie.Trie(path.read_bytes(), decode=True)
    again = written_out.query(a, b, np.arange(2500).repeat(50), np.tile(np.arange(50), 2500))
    assert all((x == y).all() for x, y in zip(again, (own2, rest2, rest3, own3)))
    of = {p: i for i, p in enumerate(pairs)}
    for k, p in enumerate(zip(a.tolist(), b.tolist())):
        want = (n2[of[p]] - 0.5) / total[p[0]] if p in of else 0
        assert ngram_trie.probability(own2[k]) == pytest.approx(want, rel=10 ** (0.51 / ngram_trie.STEPS) - 1)
        assert (rest2[k] > 0) == (p[0] < 45)
    got = {(k // 50, k % 50) for k in np.flatnonzero(own3)}
    place = {p: k for k, p in enumerate(zip(a.tolist(), b.tolist()))}
    assert got == {(place[pairs[i]], w) for i, w in triples}
    total3 = np.bincount(at, weights=n3, minlength=len(pairs))
    for (i, w), n in zip(triples, n3):
        code = own3[place[pairs[i]] * 50 + w]
        assert ngram_trie.probability(code) == pytest.approx((n - 0.7) / total3[i], rel=10 ** (0.51 / ngram_trie.STEPS) - 1)


def test_long_texts_are_cut_at_words(monkeypatch):
    monkeypatch.setattr(lm_scoring, "_SLICE", 7)
    text = b"one  TWO three\nfour\x0bfive-is-a-long-word " * 20
    numbers = lm_scoring._Words()
    found = lm_scoring.tokens(text, numbers)
    names = list(numbers)
    assert [names[i] for i in found] == [*text.lower().split(), b""]
