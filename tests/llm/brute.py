"""Plain versions of the operators, for tests: direct, quadratic, in memory."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


class Union:
    def __init__(self):
        self.p = {}

    def root(self, x):
        self.p.setdefault(x, x)
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.p[max(a, b)] = min(a, b)


def substring_dedup(docs, n=50):
    """(doc_id, n_words, n_removed, kept_sha256) of (doc_id, text)."""
    least = {}
    for doc_id, text in docs:
        w = words(text)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if doc_id is not None:
                least[key] = min(least.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in docs:
        w, gone = words(text), set()
        for i in range(len(w) - n + 1):
            if doc_id is not None and least[tuple(w[i : i + n])] < doc_id:
                gone.update(range(i, i + n))
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def shingle_sets(docs, k=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for doc_id, text in docs:
        w = words((text or "").translate(low))
        out[doc_id] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    return out


def jaccard(docs):
    """doc_id to (set size, component)."""
    sets, union, has = shingle_sets(docs), Union(), defaultdict(list)
    for d, s in sets.items():
        for x in s:
            has[x].append(d)
    for d, s in sets.items():
        shared = Counter(e for x in s for e in has[x] if e < d)
        for e, both in shared.items():
            if 100 * both >= 75 * (len(s) + len(sets[e]) - both):
                union.join(d, e)
    return {d: (len(s), union.root(d)) for d, s in sets.items()}


def cosine(rows, c=0.9):
    """vec_id to (links, component)."""
    ids = [i for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([v for i, v in rows if i in set(ids)], float).reshape(len(ids), -1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit, union = x @ x.T >= c, Union()
    np.fill_diagonal(hit, False)
    for a, b in zip(*np.nonzero(hit)):
        union.join(ids[a], ids[b])
    n = dict(zip(ids, hit.sum(axis=1).tolist()))
    return {i: (n.get(i, 0), union.root(i)) for i, _ in rows}


def topk(rows, every=20, k=20, scale=64):
    """(query_id, rank, vec_id, score) of (vec_id, vector): every row whose id is divisible by `every` against all others."""
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(good):
        if i % every == 0:
            ranked = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v)))), j) for m, (j, v) in enumerate(good) if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(ranked[:k])]
    return out


def url_model(pages, host_path, verdict_of, max_word=63, smoothing=0.5, letter=2.3):
    """(words of the host, score) of each of pages (url, html); host_path: of a url; verdict_of: the rules' verdict or None."""
    counts = Counter(w for _, html in pages for w in re.findall("[a-z]+", ascii_lower(html or "")) if len(w) <= max_word)
    total = max(1, sum(counts.values()))

    def split(run):
        best = {0: (0.0, ())}
        for end in range(1, len(run) + 1):
            options = []
            for size in range(1, min(max_word, end) + 1):
                w = run[end - size : end]
                cost = math.log(total / counts[w]) if w in counts else math.log(total * 10) + letter * size
                options.append((best[end - size][0] + cost, -size, best[end - size][1] + (w,)))
            cost, _, words = min(options)
            best[end] = (cost, words)
        return best[len(run)][1]

    def tokens(host, path):
        return [f"{side}:{w}" for side, text in (("h", host), ("p", ascii_lower(path))) for part in re.findall("[a-z]+|[0-9]+", text) for w in (split(part) if part[0] > "9" else (f"#{min(len(part), 9)}",))]

    rows = [(tokens(*host_path(u)), verdict_of(*host_path(u))) for u, _ in pages]
    seen = {v: Counter(t for found, own in rows if own == v for t in found) for v in ("allow", "block")}
    both = seen["allow"].keys() | seen["block"].keys()
    rate = lambda t, v: math.log((seen[v][t] + smoothing) / (sum(seen[v].values()) + smoothing * (len(both) + 1)))
    n = Counter(v for _, v in rows)
    prior = math.log((n["block"] + 1) / (n["allow"] + 1))
    return [(" ".join(t[2:] for t in found if t[0] == "h"), prior + sum(rate(t, "block") - rate(t, "allow") for t in found if t in both)) for found, _ in rows]


def ascii_lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def language_model(rows, bucket, buckets, smoothing=0.5):
    """text to (language, score), by plain multinomial naive Bayes fitted on rows (text, lang); bucket: of three characters."""
    memo = {}

    def grams(text):
        text = f" {text.lower()} "
        cut = [text[i : i + 3] for i in range(len(text) - 2)]
        memo.update((g, bucket(g)) for g in set(cut) - memo.keys())
        return [memo[g] for g in cut]

    counts, docs = defaultdict(Counter), Counter(lang for _, lang in rows)
    for text, lang in rows:
        counts[lang].update(grams(text))
    langs = sorted(docs)

    def predict(text):
        if not any(map(str.isalpha, text or "")):
            return "und", 0.0
        own = grams(text)
        total = [math.log(docs[x] / len(rows)) + sum(n * math.log((counts[x][g] + smoothing) / (counts[x].total() + smoothing * buckets)) for g, n in Counter(own).items()) for x in langs]
        best = total.index(max(total))
        return langs[best], 1 / sum(math.exp((t - total[best]) * min(1, 50 / len(own))) for t in total)

    return predict
