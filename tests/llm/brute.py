"""The contracts in plain Python, one text at a time or all against all."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def quality_counts(text):
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(windows)
    covered = set()
    for i, x in enumerate(windows):
        if seen[x] >= 2:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


def simhash(text, n=3):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(w)
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict[int, int], radius=2) -> dict[int, int]:
    label = {d: d for d in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                ra, rb = root(a), root(b)
                label[max(ra, rb)] = min(ra, rb)
    return {d: root(d) for d in ids}


def _digest(spans):
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
    return hashlib.sha256(joined.encode()).hexdigest()


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    text = text or ""
    spans = []
    count = Counter()
    for rank, (kind, pattern) in enumerate(
        {
            "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        }.items()
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and _luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                spans.append((m.start(), rank, m.end(), kind))
                count[kind] += 1
    return *(count[k] for k in ("email", "ip", "card", "phone")), _digest(spans), spans


def secrets(text):
    text = text or ""
    spans, count = [], Counter()
    for rank, (kind, pattern) in enumerate(
        {
            "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            "access": r"AKIA[A-Z0-9]+",
            "hex": r"[0-9a-f]+",
        }.items()
    ):
        for m in re.finditer(pattern, text):
            if {"assign": lambda: len(m[2]) >= 12, "access": lambda: len(m[0]) >= 18, "hex": lambda: len(m[0]) >= 16}[
                kind
            ]():
                spans.append((m.start(), rank, m.end(), kind))
                count[kind] += 1
    return *(count[k] for k in ("assign", "access", "hex")), _digest(spans), spans


def substring_dedup(texts: dict[int, str | None], size=20):
    first: dict[tuple, tuple] = {}
    for d in sorted(texts):
        w = words(texts[d])
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), (d, i))
    out = {}
    for d, t in texts.items():
        w = words(t)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (d, i):
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def suffix_dedup(texts: dict[int, str | None], size=50):
    first: dict[bytes, int] = {}
    for d in sorted(texts):
        b = (texts[d] or "").encode()
        for i in range(len(b) - size + 1):
            first.setdefault(b[i : i + size], d)
    out = {}
    for d, t in texts.items():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < d:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def token_rows(texts: dict[int, str | None], tokenizer, end_id=2):
    out, start = {}, 0
    for d in sorted(texts):
        ids = [*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, end_id]
        out[d] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    return out


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), list(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def tiles(doc: list[str], item: list[str], least=5):
    """Greedy string tiling by trying every pair of starts, longest first."""
    in_doc, in_item = [False] * len(doc), [False] * len(item)
    while True:
        best = (least - 1, 0, 0)
        for p in range(len(item)):
            for q in range(len(doc)):
                n = 0
                while (
                    p + n < len(item)
                    and q + n < len(doc)
                    and item[p + n] == doc[q + n]
                    and not in_item[p + n]
                    and not in_doc[q + n]
                ):
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < least:
            return sum(in_item)
        in_item[p : p + n] = [True] * n
        in_doc[q : q + n] = [True] * n
