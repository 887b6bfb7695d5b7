"""What the bootstrap learns: against plain Python, and on planted identifiers."""

from __future__ import annotations

import math
import random

import pytest
from conftest import LOREM, frame

from auditlens.llm import contextual_pii as pii


def brute_bootstrap(occurrences, rounds=pii.ROUNDS):
    edges = {(p, v) for p, v, _ in occurrences}
    seeds = {(v, k) for _, v, k in occurrences if k}
    seeded = {v for v, _ in seeds}
    known = {s: 1.0 for s in seeds}
    accepted = {}
    for _ in range(rounds):
        accepted = {}
        for p in {p for p, _ in edges}:
            values = [v for q, v in edges if q == p]
            for kind in {k for _, k in known}:
                mass = [known[v, kind] for v in values if (v, kind) in known]
                if len(mass) >= pii.MIN_SUPPORT and sum(mass) / len(values) >= pii.MIN_SCORE:
                    accepted[p, kind] = sum(mass) / len(values)
        found = {}
        for (p, kind), score in accepted.items():
            for q, v in edges:
                if q == p and v not in seeded:
                    found[v, kind] = found.get((v, kind), 0.0) + math.log(1 - min(score, 0.99))
        known = {s: 1.0 for s in seeds} | {x: 1 - math.exp(y) for x, y in found.items()}
    return {
        (p, v, k)
        for (v, k), c in known.items()
        if v not in seeded and c >= pii.MIN_SCORE
        for p, q in edges
        if q == v and (p, k) in accepted
    }


@pytest.mark.parametrize("seed", range(4))
def test_bootstrap_equals_plain_python(spark, seed):
    rng = random.Random(seed)
    kinds = {f"v{i}": rng.choice(["phone", "card", "email", None]) for i in range(60)}
    rows = []
    for p in range(14):
        liked = rng.choice(["phone", "card", "email"])
        good = [v for v, k in kinds.items() if k == liked]
        other = [v for v, k in kinds.items() if k is None or rng.random() < 0.05]
        rows += [(f"p{p}", v, kinds[v]) for v in rng.sample(good, min(len(good), rng.randint(1, 9)))]
        rows += [(f"p{p}", v, kinds[v]) for v in rng.sample(other, min(len(other), rng.randint(0, 3)))]
    df = spark.createDataFrame(rows, "pattern string, value string, kind string")
    found = {(r["pattern"], r["value"], r["kind"]) for r in pii.bootstrap(df).collect()}
    assert found == brute_bootstrap(rows)


def luhn_number(rng, valid=True):
    digits = [rng.randint(1, 9) for _ in range(15)]
    total = sum(d * 2 - 9 * (d > 4) if i % 2 == 0 else d for i, d in enumerate(reversed(digits)))
    return "".join(map(str, digits)) + str((10 - total % 10 + (0 if valid else 5)) % 10)


def spaced(number):
    return " ".join(number[i : i + 4] for i in range(0, 16, 4))


def test_planted_identifiers(spark):
    """Spaced numbers in the contexts of known ones are found whole; those of other contexts are left alone."""
    rng = random.Random(5)
    word = lambda: rng.choice(LOREM.split())
    texts, planted, decoys = [], {}, 0
    contexts = {"phone": ["ring me", "my number"], "card": ["card no:", "charged to"]}
    for i in range(160):
        kind = rng.choice(["phone", "card"])
        number = f"+1 {rng.randint(200, 999)} 555 {rng.randint(1000, 9999)}" if kind == "phone" else spaced(luhn_number(rng))
        texts.append(f"{word()} {word()} {rng.choice(contexts[kind])} {number} {word()} and {word()}")
    for _ in range(24):  # no base pattern matches these
        kind = rng.choice(["phone", "card"])
        number = f"{rng.randint(200, 999)} 555-{rng.randint(1000, 9999)}" if kind == "phone" else spaced(luhn_number(rng, False))
        before = f"{word()} {word()} {rng.choice(contexts[kind])} "
        planted[len(texts)] = f"{kind}:{len(before)}:{len(before) + len(number)}"
        texts.append(f"{before}{number}, {word()}")
    for i in range(120):
        decoys += 1
        texts.append(f"{word()} {rng.choice(['we counted', 'part no', 'built in'])} {rng.randint(10**6, 10**9)} {word()}")
    found = {r["doc_id"]: r["spans"] for r in pii.pii_digest(pii.find_pii(frame(spark, texts))).collect()}
    base = set(range(160))
    learned = {d: s for d, s in found.items() if s and d not in base}
    right = sum(planted.get(d) == s for d, s in learned.items())
    assert right >= 0.9 * len(learned) and right >= 0.9 * len(planted)
    # Where a base span stands, nothing is added inside it.
    assert all(len(found[d].split(",")) == 1 for d in base)


def test_long_words_before_an_identifier_are_whole(spark):
    """Contexts that end alike but begin differently are different patterns."""
    long = "x" * 200
    texts = [f"a{long} call +1 555 010 {1000 + i} ok" for i in range(6)] + [f"b{long} call 555-010-7777 ok", f"a{long} call 555-010-8888 ok"]
    found = {r["doc_id"]: r["spans"] for r in pii.pii_digest(pii.find_pii(frame(spark, texts))).collect()}
    assert found[6] == "" and found[7].startswith("phone:")


def test_blanks_between_the_words_of_a_context(spark):
    texts = [f"x call{' ' * (3 * i + 1)}me\n\n\t +1 555 010 {1000 + i} ok" for i in range(6)] + ["call me 555-010-7777"]
    found = {r["doc_id"]: r["spans"] for r in pii.pii_digest(pii.find_pii(frame(spark, texts))).collect()}
    assert found[6] == "phone:8:20"
