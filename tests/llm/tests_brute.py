"""Plain versions of two pipeline decisions."""

import re

import xxhash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_keepers(texts):
    """The smallest id of every group of linked fingerprints."""
    ids = sorted(texts)
    prints = {i: fingerprint(texts[i]) for i in ids}
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) == i}


def contaminated(text, item, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    w, b = words(text), words(item)
    wins = {tuple(b[k : k + window]) for k in range(len(b) - window + 1)}
    hit = {p for k in range(len(w) - window + 1) if tuple(w[k : k + window]) in wins for p in range(k, k + window)}
    return bool(hit) and 20 * len(hit) >= len(w)
