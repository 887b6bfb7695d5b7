"""Coders, merges and tilings without Spark."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlens.llm import decontaminate, packing, substring_dedup, suffix_dedup
from auditlens.llm.decontaminate import Seeds, longest_tiles, plain_words, scan
from auditlens.llm.queries import TOKENIZER
from auditlens.llm.rans import Coder, quantise
from auditlens.llm.token_files import PieceEncoder

QUICK = settings(max_examples=60, deadline=None)


@QUICK
@given(st.lists(st.integers(0, 300), max_size=3000), st.integers(1, 70), st.integers(1, 9))
def test_rans_round_trip(ids, lanes, rows):
    ids = np.array(ids, dtype=np.uint32)
    coder = Coder(quantise(np.bincount(ids, minlength=301)))
    block = coder.encode(ids, lanes, rows)
    assert coder.decode(block).tolist() == ids.tolist()


def test_rans_decodes_parts_and_notices_damage():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.3, 200_000) % 50_000).astype(np.uint32)
    coder = Coder(quantise(np.bincount(ids, minlength=50_257)))
    block = coder.encode(ids, 512)
    assert len(block) < 1.9 * len(ids)
    assert coder.decode(block, [1]).tolist() == ids[512 * 128 : 2 * 512 * 128].tolist()
    for at in (5, 60, len(block) // 2, len(block) - 1):
        broken = bytearray(block)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            coder.decode(bytes(broken))


@QUICK
@given(st.lists(st.integers(0, 10**12), min_size=1, max_size=200))
def test_frequencies_fill_the_table(counts):
    found = quantise(np.array(counts))
    assert found.sum() == (1 << 20 if any(counts) else 0)
    assert all((f > 0) == (c > 0) for f, c in zip(found.tolist(), counts))


def test_pieces_give_the_ids_of_whole_texts():
    rng = random.Random(3)
    marks = ["a", "B", "é", "9", "12", "'s", "'ll", "don't", ".", ",", "!!", "###", " ", " ", "  ", "\n", "\n\n", "\t", " \n", "\x0b"]
    marks += [" ", "　", "​", "日本", "😀", "<|endoftext|>", "-", "_", "ñ", "Ā", "ſ", "\x1c", "\r\n", "\x00", "İ"]
    encoder = PieceEncoder(TOKENIZER)
    for _ in range(300):
        some = ["".join(rng.choice(marks) for _ in range(rng.randrange(30))) for _ in range(5)]
        for text, packed in zip(some, encoder.encode(some)):
            ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(packed, dtype=encoder.wide).tolist() == ids


@QUICK
@given(st.lists(st.lists(st.binary(max_size=6), max_size=30), max_size=9))
def test_loser_tree_merges_with_common_prefixes(runs):
    runs = [sorted((s, b"", i, n) for n, s in enumerate(run)) for i, run in enumerate(runs)]
    merged = list(suffix_dedup.merge_runs([suffix_dedup.read_run(suffix_dedup.write_run(r)) for r in runs]))
    assert [s for _, s in merged] == sorted(s for r in runs for s in r)
    before = b""
    for n, s in merged:
        assert n == suffix_dedup.shared_prefix(before, s[0])
        before = s[0]


@QUICK
@given(st.lists(st.tuples(st.text("ab", min_size=7, max_size=12), st.integers(0, 9)), max_size=30), st.lists(st.text("ab", min_size=7, max_size=9), max_size=4))
def test_cut_runs_hold_all_suffixes(found, splits):
    run = sorted({(r.encode(), b"left", key, at) for at, (r, key) in enumerate(found)})
    numbers = sorted({suffix_dedup.prefix_number(s.encode()) for s in splits})
    parts = dict(suffix_dedup.cut_run(suffix_dedup.write_run(run), numbers))
    for n, part in parts.items():
        some = [s for _, s in suffix_dedup.read_run(part)]
        assert some == [s for s in run if sum(x <= suffix_dedup.prefix_number(s[0]) for x in numbers) == n]
    assert sum(len(list(suffix_dedup.read_run(p))) for p in parts.values()) == len(run)


@QUICK
@given(st.data())
def test_repeats_are_those_of_a_search_for_every_string(data):
    gram = b"0123456789abcdef"
    texts = data.draw(st.lists(st.tuples(st.binary(min_size=34, max_size=34), st.binary(min_size=34, max_size=34)), max_size=3))
    texts = [(a, b, *data.draw(st.tuples(st.integers(0, 34), st.integers(0, 34)))) for a, b in texts * 4]
    group = []
    for n, (before, after, cut, keep) in enumerate(texts):
        left = before[cut:]
        right = gram + after[:keep]
        if len(left) + len(right) >= 50:
            group.append((right, left, data.draw(st.integers(0, 4)), 1000 * n))
    group.sort()
    common = [0, *[suffix_dedup.shared_prefix(a[0], b[0]) for a, b in zip(group, group[1:])]][: len(group)]
    strings: dict = {}
    for right, left, key, _ in group:
        whole = left + right
        for i in range(len(whole) - 49):
            place = (len(left) - i, whole[i : i + 50])
            strings[place] = min(key, strings.get(place, key))
    wanted = []
    for right, left, key, at in group:
        whole = left + right
        hits = [i for i in range(len(whole) - 49) if strings[len(left) - i, whole[i : i + 50]] < key]
        if hits:
            wanted.append((key, at - len(left) + hits[0], at - len(left) + hits[-1] + 50))
    assert sorted(zip(*[x.tolist() for x in suffix_dedup.repeats(common, group)])) == sorted(wanted)


@QUICK
@given(st.lists(st.integers(0, 5), min_size=40, max_size=200), st.integers(2, 40))
def test_least_of_neighbours(values, width):
    v = np.array(values, dtype=np.uint64)
    assert substring_dedup.least_of(v, width).tolist() == [min(values[i : i + width]) for i in range(len(v) - width + 1)]
    places = suffix_dedup.least_places(v, width).tolist()
    assert places == [i + int(np.argmin(values[i : i + width])) for i in range(len(v) - width + 1)]


def test_long_texts_are_cut_without_losing_windows(monkeypatch):
    monkeypatch.setattr(substring_dedup, "UNIT_WORDS", 7)
    text = b" ".join(b"%d" % i for i in range(100))
    found = [(at + i, tuple(w[i : i + 20])) for _, at, part in substring_dedup._units([(0, text)]) for w in [part.split()] for i in range(len(w) - 19)]
    w = text.split()
    assert sorted(found) == [(i, tuple(w[i : i + 20])) for i in range(81)]
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 64)
    found = [(at + i, part[i : i + 50]) for _, at, part in suffix_dedup._units([(0, text)]) for i in range(len(part) - 49)]
    assert sorted(found) == [(i, text[i : i + 50]) for i in range(len(text) - 49)]


def test_different_windows_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup, "combined", lambda *parts: parts[0] * np.uint64(0))
    base = [b"w%d" % i for i in range(60)]
    texts = [b" ".join(base[a : a + 25]) for a in (0, 3, 0, 30, 3)]
    keys, at = np.array([1, 2, 3, 4, 5]), np.zeros(5, dtype=np.int64)
    key, place = substring_dedup._repeated(keys, at, texts)
    first, expected = {}, set()
    for k, t in zip(keys.tolist(), texts):
        w = t.split()
        for i in range(6):
            if first.setdefault(tuple(w[i : i + 20]), (k, i)) != (k, i):
                expected.add((k, i))
    assert set(zip(key.tolist(), place.tolist())) == expected


@QUICK
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 9)), max_size=30))
def test_ranges_are_joined(pairs):
    covered = {x for a, n in pairs for x in range(a, a + n)}
    first, last = packing.joined_ranges(np.array([a for a, _ in pairs], dtype=np.int64), np.array([a + n for a, n in pairs], dtype=np.int64))
    assert {x for a, b in zip(first.tolist(), last.tolist()) for x in range(a, b)} == covered
    assert all(b < c for b, c in zip(last.tolist(), first[1:].tolist()))


@QUICK
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), min_size=5, max_size=25))
def test_tiling_equals_brute_force(doc, item):
    doc_words, item_words = [f"w{x}" for x in doc], [f"w{x}" for x in item]
    seeds = Seeds([(1, " ".join(item_words).encode())])
    expected = brute.tiles(doc_words, item_words)
    found = list(scan([" ".join(doc_words).encode()], seeds, coverage=1e-9))
    assert (found[0][2] if found else 0) == expected


def test_passages_in_another_order_are_found():
    item = [f"t{i}" for i in range(40)]
    mixed = item[20:40] + ["other"] * 9 + item[10:20] + ["words"] * 4 + item[0:10]
    seeds = Seeds([(7, " ".join(item).encode())])
    text = "Before. " + " ".join(mixed).upper().replace("T5 ", "t5, ") + " after"
    assert [f[1:] for f in scan([None, b"", text.encode()], seeds)] == [(0, 40, 3)]
    assert not list(scan([" ".join(item[:31] + ["x"]).encode()], seeds))
    assert longest_tiles([(5, 0, 0), (4, 9, 9)]) == [(5, 0, 0)]
    assert plain_words("Don't STOP—now!".encode()) == ["don".encode(), b"t", "stop—now".encode()]


def test_blocks_of_the_benchmark_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 20)
    items = [(i, " ".join(f"b{i}w{j}" for j in range(12))) for i in range(30)]
    benchmark = spark.createDataFrame(items + [(99, None)], "item_id long, text string")
    found = list(decontaminate.blocks(benchmark, "item_id", "text"))
    assert len(found) > 5 and sorted(i for b in found for i, _ in b) == list(range(30))
    docs = spark.createDataFrame([(i, t) for i, t in items], "doc_id long, text string")
    leaks = decontaminate.find_leaks(docs, benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks) == [(i, i) for i in range(30)]
    assert decontaminate.clean_documents(docs, benchmark).count() == 0
