"""Plain Python forms of the training-text operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def components(docs, percent=85):
    """{doc_id: (shingles, component)} for (doc_id, text) rows with distinct ids."""
    sets = {}
    for d, text in docs:
        w = words(text, True)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def quality(text):
    text = text or ""
    w = words(text)

    def covered(n):
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        count, out = Counter(grams), set()
        for i, g in enumerate(grams):
            if count[g] > 1:
                out |= set(range(i, i + n))
        return out

    seen, lines, line_chars = set(), 0, 0
    for line in text.split("\n"):
        if own := words(line):
            if line in seen:
                lines, line_chars = lines + 1, line_chars + sum(map(len, own))
            seen.add(line)
    chars = sum(map(len, w))
    repeat = len(covered(5))
    failed = len(w) < 10 or 100 * repeat > 20 * len(w)
    limits = {5: 0.30, 6: 0.28, 8: 0.26, 10: 0.25}
    parts = [sum(len(w[i]) for i in covered(n)) for n in limits]
    good = all(p <= most * chars for p, most in zip(parts, limits.values())) and line_chars <= 0.30 * chars
    return {
        "n_words": len(w), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": lines, "n_repeat_words": repeat,
        "base_failed": failed, "kept": not failed and good, "dup_line_chars": line_chars, "covered": parts,
    }


def without_repeats(docs, n=20):
    """{doc_id: (words, removed, kept text)} for (doc_id, text) rows in doc_id order."""
    seen, out = set(), {}
    for d, text in sorted(docs, key=lambda r: r[0]):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if key in seen:
                gone[i : i + n] = [True] * n
            seen.add(key)
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def suffix_scores(docs, depth, least, gain, pull):
    """{doc_id: (held out, tokens, known, train tokens, base score, score)}; contexts of up to ``depth`` words."""
    end = ("end",)
    tokens = {d: [*words(t, True), end] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in tokens}
    train = [t for d, t in tokens.items() if not held[d]]
    c = Counter(tuple(t[i : i + n]) for t in train for n in range(1, depth + 2) for i in range(len(t) - n + 1))
    n, v = sum(len(t) for t in train), len({w for t in train for w in t})
    states = set()
    base = lambda w: (c[w,] + 0.5) / (n + 0.5 * (v + 1))

    def odds(context, w):
        """By the longest suffix of the context that is a state."""
        if not context:
            return base(w)
        back = odds(context[1:], w)
        if context not in states:
            return back
        weight = pull[min(len(context), len(pull)) - 1]
        return (c[*context, w] + weight * back) / (c[context] + weight)

    for k in range(1, depth + 1):
        gains, weight = Counter(), pull[min(k, len(pull)) - 1]
        for t in train:
            for i in range(k, len(t)):
                context = tuple(t[i - k : i])
                if c[context] >= least:
                    back = odds(context[1:], t[i])
                    gains[context] += math.log((c[*context, t[i]] - 1 + weight * back) / (c[context] - 1 + weight) / back)
        states |= {x for x, g in gains.items() if g >= gain}
    out = {}
    for d, t in tokens.items():
        score = sum(math.log10(odds(tuple(t[max(0, i - depth) : i]), w)) for i, w in enumerate(t))
        out[d] = (held[d], len(t), sum(c[w,] > 0 for w in t), n, sum(math.log10(base(w)) for w in t), score)
    return out


def personal_data(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def tiling(item, text, least=5):
    """Words of the item under greedy tiles."""
    free_i, free_t, total = [True] * len(item), [True] * len(text), 0
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and free_i[i + k] and free_t[j + k]:
                    k += 1
                if k > best:
                    best, found = k, []
                if k == best and k >= least:
                    found.append((i, j))
        if not found:
            return total
        for i, j in found:
            if all(free_i[i : i + best]) and all(free_t[j : j + best]):
                free_i[i : i + best] = free_t[j : j + best] = [False] * best
                total += best


def contaminated(docs, items, coverage=0.5):
    """{doc_id: item ids}."""
    known = [(i, words(t, True)) for i, t in items]
    seeds = defaultdict(set)
    for i, w in known:
        for j in range(len(w) - 4):
            seeds[tuple(w[j : j + 5])].add(i)
    out = {}
    for d, text in docs:
        w = words(text, True)
        near = {i for j in range(len(w) - 4) for i in seeds.get(tuple(w[j : j + 5]), ())}
        out[d] = sorted(i for i, item in known if i in near and tiling(item, w) >= coverage * len(item))
    return out


def mix(docs, weights=(3.0, 1.0, 2.0), share=1.5, ceiling=2.0, seed="mix-1"):
    """({doc_id: copies}, {source: (size, target)}) for (doc_id, text, source) rows with distinct ids."""
    rows = [(d, source, len(words(text))) for d, text, source in docs]
    names = sorted({s for _, s, _ in rows if s is not None}) + [None] * any(s is None for _, s, _ in rows)
    size = {s: sum(n for _, x, n in rows if x == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(size.values())
    while free:
        rate = left / sum(weight[s] for s in free)
        full = {s for s in free if rate * weight[s] > ceiling * size[s]}
        if not full:
            target |= {s: rate * weight[s] for s in free}
            break
        target |= {s: ceiling * size[s] for s in full}
        left -= sum(ceiling * size[s] for s in full)
        free -= full
    digest = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
    copies = {}
    for s in names:
        step = round(target[s] / size[s] * 2**32) if size[s] else 0
        order = sorted((math.floor(math.log2(n) * 8 + 1e-6) if n else -1, digest(f"{seed}{d}"), d) for d, x, n in rows if x == s)
        at = digest(f"{seed}\x01{s if s is not None else chr(0)}")
        for _, _, d in order:
            copies[d] = (at + step) // 2**32 - at // 2**32
            at += step
    return copies, {s: (size[s], target[s]) for s in names}


def token_records(docs, encode):
    """[(doc_id, start, ids)] in doc_id order; ``encode`` maps texts to id lists."""
    rows = sorted(docs, key=lambda r: r[0])
    out, start = [], 0
    for (d, _), ids in zip(rows, encode([t or "" for _, t in rows])):
        own = np.array([*ids, 0])
        out.append((d, start, own))
        start += len(own)
    return out
