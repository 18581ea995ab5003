"""Plain, slow versions of what the operators compute."""

import hashlib
import math
import re
from collections import Counter
from itertools import combinations

SPACE = re.compile("[^\x20\x09-\x0d]+")
ODD_TEXTS = [None, "", " ", "\n\n\t", "a", "a b", "one two three", "x" * 5000, "word " * 3000, "ÀÉ ß \u0130 Σς", "!!! ### 12", "\U0001f600 中文", "secret", "AKIA"]


def secrets(text):
    text, found = text or "", []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def spelled(found):
    return ",".join(f"{('assign', 'access', 'hex', 'entropy')[k]}:{a}:{b}" for a, k, b in found)


def fingerprint(text):
    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """{doc: fp} -> {doc: smallest doc reachable}."""
    root = {d: d for d in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(fps)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: top(d) for d in docs}


def suffix_removal(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(r, gone, strict=True) if not y)).hexdigest()))
    return out


def rule_counts(text):
    text = text or ""
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def language(text, train):
    """(language, score) by word-first backoff, from (text, language) rows."""
    split = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    parts = lambda w, k: [f"<{w}>"[i : i + k] for i in range(len(w) + 3 - k)]
    langs = sorted({lang for _, lang in train})
    tables = {k: {lang: Counter() for lang in langs} for k in range(6)}  # 0: words
    for t, lang in train:
        for w in split(t):
            tables[0][lang][w] += 1
            for k in range(1, 6):
                tables[k][lang].update(parts(w, k))
    keys = {k: set().union(*t.values()) for k, t in tables.items()}

    def logs(k, x):
        return [math.log((tables[k][lang][x] + 0.5) / (sum(tables[k][lang].values()) + 0.5 * len(keys[k]))) for lang in langs]

    def scores(w):
        if w in keys[0]:
            return logs(0, w)
        for k in (5, 4, 3, 2, 1):
            if found := [logs(k, g) for g in parts(w, k) if g in keys[k]]:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return [0.0] * len(langs)

    words = split(text)
    if not words:
        return "und", 0.0
    total = [sum(x) for x in zip(*map(scores, words), strict=True)]
    share = [math.exp(x - max(total)) for x in total]
    return langs[total.index(max(total))], max(share) / sum(share)


def url_rules(rows, min_support, min_confidence):
    """{(sorted tokens, verdict): (confidence, support, evidence)} from (tokens, verdict) rows, by counting all sets of tokens."""
    n, of, hits, base = len(rows), Counter(), Counter(), Counter(v for _, v in rows)
    for tokens, verdict in rows:
        for k in range(1, len(tokens) + 1):
            for own in combinations(sorted(tokens), k):
                of[own] += 1
                hits[own, verdict] += 1
    odds = lambda a, b: math.log((a + 0.5) / (b - a + 0.5))
    kept = {}
    for (own, verdict), h in hits.items():
        c = h / of[own]
        if h / n >= min_support and c >= min_confidence and c > base[verdict] / n:
            kept[own, verdict] = (c, h / n, odds(h, of[own]) - odds(base[verdict], n))
    return {(a, v): x for (a, v), x in kept.items() if not any(set(b) < set(a) and v == w and y[0] >= x[0] for (b, w), y in kept.items())}


def leak(text, item, stretch_words):
    """The best share of an item's words that is a common subsequence with a stretch of a text."""
    split = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()
    own, words = split(item), split(text)
    span = stretch_words(len(own))
    best = max(lcs(own, words[i : i + span]) for i in range(max(1, len(words) - span + 1)))
    return best / len(own)
