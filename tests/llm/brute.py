"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def alnum(text):
    return ALNUM_WORD.findall((text or "").translate(LOWER))


def contamination(docs, items, window=13):
    """docs, items: [(id, text)]. -> [(id, n_words, n_hit, n_items, sha, contaminated)]"""
    by = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        if w:
            for a in range(max(1, len(w) - window + 1)):
                by[tuple(w[a : a + window])].add(i)
    lengths = {len(k) for k in by}
    out = []
    for d, t in docs:
        w, hit, ids = alnum(t), set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in by:
                    hit.update(range(a, a + n))
                    ids |= {str(x) for x in by[k] if x is not None}
        out.append((d, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def quality(text):
    t = text or ""
    w = SPACE_WORD.findall(t)
    lines = [x for x in t.split("\n") if SPACE_WORD.search(x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return (
        len(w),
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", t)),
        len(lines) - len(set(lines)),
        len(covered),
        len(w) < 10 or 100 * len(covered) > 20 * len(w),
    )


def fingerprint(text):
    w = SPACE_WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(docs):
    """[(id, text)] -> [(id, fingerprint, component)]"""
    prints = [fingerprint(t) for _, t in docs]
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x] = parent[parent[x]]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    low = {}
    for (d, _), p in zip(docs, prints, strict=True):
        if d is not None:
            low[find(p)] = min(d, low.get(find(p), d))
    return [(d, f"{p:016x}", low.get(find(p))) for (d, _), p in zip(docs, prints, strict=True)]


PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def licenses(text):
    w, found = alnum(text), []
    for p, label in PHRASES.items():
        found += [(i, label) for i in range(len(w) - len(p) + 1) if tuple(w[i : i + len(p)]) == p]
    at = [i for i, _ in found]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})))


def crc(text):
    return zlib.crc32((text or "").encode())


def url(u):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    if u is None or "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def repeats(docs, window=20):
    """[(id, text)] -> [(id, n_words, n_removed, sha)]; ids distinct"""
    words = {d: SPACE_WORD.findall(t or "") for d, t in docs}
    seen, out = set(), {}
    for d in sorted(words):
        w, gone = words[d], set()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone.update(range(i, i + window))
            else:
                seen.add(k)
        out[d] = (d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return [out[d] for d, _ in docs]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def personal(text):
    t = text or ""
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    kinds = {"email": email, "ip": ip, "card": card, "phone": phone}
    return tuple(map(len, kinds.values())) + (sha(",".join(f"{k}:{a}:{b}" for k, v in kinds.items() for a, b in v)),)
