"""The operators of the pipeline once more, straight from their definitions, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from amplispark.llm import language, quality


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def quantile(values, q):
    """The least value that at least a share q of the values doesn't exceed."""
    values = sorted(values)
    return values[max(0, math.ceil(q * len(values)) - 1)] if values else None


class KneserNey:
    """Interpolated modified Kneser-Ney over bytes, padded with None before a text."""

    def __init__(self, texts):
        top = Counter()
        for t in texts:
            padded = (None,) * (quality.ORDER - 1) + tuple(t.encode())
            top.update(padded[i : i + quality.ORDER] for i in range(len(padded) - quality.ORDER + 1))
        self.counts = {quality.ORDER: top}
        for n in range(quality.ORDER - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.discount, self.total, self.kinds = {}, {}, {}
        for n, counts in self.counts.items():
            c = Counter(counts.values())
            y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0.5
            self.discount[n] = [min(max(i - (i + 1) * y * c[i + 1] / c[i], 0.05), i - 0.05) if c[i] else 0.5 * i for i in (1, 2, 3)]
            self.total[n], self.kinds[n] = Counter(), defaultdict(Counter)
            for g, a in counts.items():
                self.total[n][g[:-1]] += a
                self.kinds[n][g[:-1]][min(a, 3)] += 1

    def p(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(self.counts[1]) + 1)
        context = gram[:-1]
        if not self.total[n][context]:
            return self.p(gram[1:])
        a = self.counts[n][gram]
        cut = sum(self.discount[n][k - 1] * c for k, c in self.kinds[n][context].items())
        own = a - self.discount[n][min(a, 3) - 1] if a else 0
        return own / self.total[n][context] + cut / self.total[n][context] * self.p(gram[1:])

    def perplexity(self, text):
        if not text:
            return None
        padded = (None,) * (quality.ORDER - 1) + tuple(text.encode())
        grams = Counter(padded[i : i + quality.ORDER] for i in range(len(padded) - quality.ORDER + 1))
        return math.exp(-sum(c * math.log(self.p(g)) for g, c in grams.items()) / sum(grams.values()))


def judged(docs, labels):
    """(perplexity, threshold, keep) of each (id, text, lang)."""
    by = defaultdict(list)
    for i, q in labels:
        if i is not None and q is not None:
            by[i].append(q)
    trusted = {i for i, qs in by.items() if min(qs) == 1}
    held = {i for i in trusted if zlib.crc32(str(i).encode()) % 8 == 0}
    model = KneserNey([t for i, t, _ in docs if i in trusted - held and t])
    found = [model.perplexity(t) for _, t, _ in docs]
    kept_back = [(lang, p) for (i, _, lang), p in zip(docs, found, strict=True) if i in held and p is not None]
    overall = quantile([p for _, p in kept_back], quality.HIGH)
    out = []
    for (_, _, lang), p in zip(docs, found, strict=True):
        own = [x for k, x in kept_back if k == lang] if lang is not None else []
        high = quantile(own, quality.HIGH) if own else overall
        out.append((p, high, p is not None and (high is None or p <= high)))
    return out


def buckets(word):
    out, points = [], [ord(c) for c in f" {word.lower()} "]
    for i in range(len(points)):
        h = 0
        for n in language.ORDERS:
            if i + n > len(points):
                break
            h = points[i] + 1 if n == 1 else h * 1_000_003 + points[i + n - 1] + n
            out.append(((h * int(language.MULTIPLIER)) % 2**64 >> 32) % language.BUCKETS)
    return out


def grams_of(text):
    return [b for w in re.findall(r"[^\x09-\x0D\x20]+", text) for b in buckets(w)]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def languages(docs):
    """(held_out, language, score, fit) of each (id, text, lang)."""
    known = [(t, lang) for i, t, lang in docs if not held_out(i) and t is not None and lang is not None]
    langs = sorted({lang for _, lang in known})
    model = np.full((language.BUCKETS, len(langs)), language.SMOOTHING)
    for t, lang in known:
        np.add.at(model[:, langs.index(lang)], grams_of(t), 1)
    logs = np.log(model / model.sum(0)).astype(np.float32)
    prior = np.log([sum(x == lang for _, x in known) / len(known) for lang in langs]).astype(np.float32)
    out = []
    for i, t, _ in docs:
        if not langs or t is None or not any(c.isalpha() for c in t):
            out.append((held_out(i), "und", 0.0, None))
            continue
        grams = grams_of(t)
        total = logs[grams].astype(np.float64).sum(0) + prior
        best = int(total.argmax())
        out.append((held_out(i), langs[best], float(1 / np.exp(total - total.max()).sum()), round(float((total[best] - prior[best]) / len(grams)), 3)))
    return out


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int("".join("1" if 2 * int(b) > len(hashes) else "0" for b in bits), 2)


def roots(fps):
    """For each fingerprint the place of the first one that links lead to."""
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def contaminated(text, items):
    own = words(text)
    for _, item in items:
        w = words(item)
        n = min(10, len(w))
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        if any(tuple(own[k : k + n]) in windows for k in range(len(own) - n + 1)):
            return True
    return False


def digest(values):
    return hashlib.sha256(values).hexdigest()
