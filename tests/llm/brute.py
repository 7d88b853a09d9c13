"""Plain single-machine versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def fails(text):
    n, _, _, _, repeated = quality(text)
    return n < 50 or 100 * repeated > 50 * n


def shingles(text):
    words = WORD.findall(text or "")
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(rows):
    """By position: the smallest key of the group, and the number of links."""
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links, holders = [0] * len(rows), defaultdict(list)
    for i, own in enumerate(sets):
        shared = Counter(j for g in own for j in holders[g])
        for j, n in shared.items():
            if 10 * n >= 8 * (len(own) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
        for g in own:
            holders[g].append(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return [(least[find(i)], links[i]) for i in range(len(rows))]


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def private(text):
    """Counts by kind, and the base spans."""
    counts, spans = [], []
    for kind, pattern in BASE.items():
        own = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                own.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(len(own))
        spans += own
    return (*counts, sha(",".join(spans)))


def masked(text, spans):
    """Text with the listed spans (``kind:start:end``) replaced, overlapping ones as one."""
    if not spans:
        return text
    parts = sorted((int(s), int(e), kind) for kind, s, e in (x.split(":") for x in spans.split(",")))
    out, at, last = [], 0, None
    for start, end, kind in parts:
        if last is None or start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        last, at = kind, max(at, end)
    return "".join(out) + text[at:]


def repeats(rows, length=50):
    words = [WORD.findall(text or "") for _, text in rows]
    seen = defaultdict(set)
    for i, own in enumerate(words):
        for k in range(len(own) - length + 1):
            seen[tuple(own[k : k + length])].add(i)
    out = set()
    for (key, _), own in zip(rows, words, strict=True):
        span = None
        for k in range(len(own) - length + 1):
            if len(seen[tuple(own[k : k + length])]) > 1:
                if span and k <= span[1]:
                    span[1] = k + length
                else:
                    if span:
                        out.add((key, *span))
                    span = [k, k + length]
        if span:
            out.add((key, *span))
    return out


def unigram(rows):
    """By position: held out, tokens, known, training tokens, base score."""
    def tokens(text):
        return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]

    held = [zlib.crc32(str(key).encode()) % 7 == 2 for key, _ in rows]
    count = Counter(t for (_, text), h in zip(rows, held, strict=True) if not h for t in tokens(text))
    n, v = sum(count.values()), len(count)
    out = []
    for (_, text), h in zip(rows, held, strict=True):
        own = tokens(text)
        out.append((h, len(own), sum(count[t] > 0 for t in own), n, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in own)))
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def lexical(docs, items, top=20):
    """(item_id, rank, doc_id, score) of rows of (id, text)."""
    held = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    held = [(doc_id, c) for doc_id, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        asked = terms(text)
        scored = []
        for doc_id, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n) // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in asked if c[t]
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:top], 1)]
    return out


def whitened(rows, k=4):
    """(vec_id, component) to (n, deviation, |whitened|, explained); one length of vectors."""
    import numpy as np

    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit, float) - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for i, x in kept:
        for c in range(1, min(k, len(values)) + 1):
            e = values[-c]
            if e > 1e-9 * max(values[-1], 1e-300):
                y = (np.array(x) - mean) @ vectors[:, -c] / math.sqrt(e)
                out.setdefault((i, c), []).append((n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), abs(float(y)), float(e / values.sum())))
    return out
