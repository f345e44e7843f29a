"""Plain statements of what the operators must give, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    w = WORD.findall(text or "")
    if len(w) >= n:
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near(docs, threshold=0.8):
    """doc_id -> (copy_of, n_copies, n_links, class_id), from all pairs of different sets."""
    sets, members = {d: shingles(t) for d, t in docs.items()}, defaultdict(list)
    for d in sorted(sets):
        members[sets[d]].append(d)
    links, top = Counter(), {m[0]: m[0] for m in members.values()}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, m), (b, k) in combinations(members.items(), 2):
        if a and b and jaccard(a, b) >= threshold - 1e-9:
            links[m[0]] += 1
            links[k[0]] += 1
            x, y = sorted((root(m[0]), root(k[0])))
            top[y] = x
    return {d: (m[0], len(m), links[m[0]], root(m[0])) for m in members.values() for d in m}


def line_runs(docs, min_words=50):
    """doc_id -> text without the lines of runs that occur earlier, from all pairs of places."""
    lines = {d: [(p, x) for p, x in enumerate((t or "").split("\n")) if WORD.search(x)] for d, t in docs.items()}
    seen, out = defaultdict(list), {}
    for d in sorted(docs):
        ls, gone = lines[d], set()
        for i in range(len(ls)):
            for e, j in seen[ls[i][1]] if ls else []:
                k = 0
                other = lines[e]
                while i + k < len(ls) and j + k < len(other) and ls[i + k][1] == other[j + k][1]:
                    k += 1
                if sum(len(WORD.findall(x)) for _, x in ls[i : i + k]) >= min_words:
                    gone.update(range(i, i + k))
            seen[ls[i][1]].append((d, i))
        runs = []
        for i in sorted(gone):
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        cut = [(ls[a][0], ls[b][0]) for a, b in runs]
        out[d] = "\n".join(x for p, x in enumerate((docs[d] or "").split("\n")) if not any(a <= p <= b for a, b in cut))
    return out


def repeated_words(words):
    g = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(g)
    return len({i + k for i, x in enumerate(g) if n[x] > 1 for k in range(3)})


def poisson_draw(name, rate):
    """Sum over parts of the number of cumulated probabilities up to the hashed number."""
    import math

    parts = max(math.ceil(rate / 16), 1)
    total = 0
    for j in range(1, parts + 1):
        u = int(hashlib.md5(f"{name}|{j}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate / parts)
        k = 0
        while c <= u and k < 200:
            k += 1
            p *= rate / parts / k
            c += p
        total += k
    return total
