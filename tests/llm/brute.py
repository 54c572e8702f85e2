"""Plain Python versions of corpus operators, for the tests."""

import collections
import hashlib
import re
from fractions import Fraction

import regex

from tideline.llm.decontamination import UNITS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def marked_words(text):
    """(word of the template, with its value) of each word, by plain Python."""
    t = text.translate(str.maketrans("#=_", "   "))
    t = regex.sub(r"\p{Lu}(?<=[^.!?:;\x22\s] .)(?=\p{Ll})[\p{L}\p{M}]*", lambda m: "#p=" + m[0], t)
    while (joined := re.sub(r"(#p=[^\W\d]+) #p=", r"\1_", t)) != t:
        t = joined
    t = re.sub(r"(?<=[0-9])[.,](?=[0-9])", "_", t.lower())
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    t = regex.sub(r"([0-9][0-9_]*)[ \x2D]?(" + units + r")(?![\p{L}\p{N}])", r" #n=\1 #u=\2 ", t).replace("%", "pct")
    t = regex.sub(r"(?<![=0-9_\p{L}])([0-9][0-9_]*)(?![\p{L}0-9_])", r" #n=\1 ", t)
    words = [w for w in regex.split(r"[^\p{L}\p{M}\p{N}#=_]+", t) if w]
    return [(w.split("=")[0] if "=" in w else w, w) for w in words]


def stretches(places):
    runs = []
    for x in sorted(places):
        if runs and runs[-1][-1] == x - 1:
            runs[-1].append(x)
        else:
            runs.append([x])
    return runs


def brute_leak(doc, item):
    """Words of the item that a document covers by counting runs at offsets within one span of 16; 0: no leak."""
    n, heavy = len(item), lambda w: sum(t.startswith("#") for t, _ in w) * 2 > 8
    if n < 8:
        hit = [w for _, w in item] in ([[w for _, w in doc]] if n < 4 and len(doc) < 4 else [[w for _, w in doc[k : k + n]] for k in range(len(doc) - n + 1)] if n >= 4 else [])
        return n if hit else 0
    windows = [item[a : a + 8] for a in range(n - 7)]
    only_heavy = all(map(heavy, windows))
    need, at = min(13, max(8, n - 1)), collections.defaultdict(list)
    for k in range(len(doc) - 7):
        at[tuple(t for t, _ in doc[k : k + 8])].append(k)
    cover = collections.defaultdict(set)
    for a, w in enumerate(windows):
        if heavy(w) and not only_heavy:
            continue
        for k in at.get(tuple(t for t, _ in w), ()):
            if not heavy(w) or doc[k : k + 8] == w:
                cover[k - a] |= set(range(a, a + 8))
    counted = collections.defaultdict(set)
    for shift, places in cover.items():
        for run in stretches(places):
            values = {(item[j][1], doc[j + shift][1]) for j in run if item[j][0].startswith("#")}
            if len({a for a, _ in values}) == len(values):
                counted[shift] |= set(run)
            else:
                for part in stretches([j for j in run if item[j] == doc[j + shift]]):
                    counted[shift] |= set(part) if len(part) >= need else set()
    best = 0
    for start in (0, 8):
        groups = collections.defaultdict(set)
        for shift, places in counted.items():
            groups[(shift + start) // 16] |= places
        best = max([best, *map(len, groups.values())])
    return best if best >= need else 0


def leaks_of(docs, items):
    """(doc, item, words) of all leaks; an item is looked for as it is and without capitals."""
    docs, items = [(i, marked_words(t)) for i, t in docs if t], [(k, marked_words(t), marked_words(t.lower())) for k, t in items if t]
    return {(i, k, words) for i, d in docs for k, *forms in items if forms[0] and (words := max(brute_leak(d, it) for it in forms))}


def brute_components(texts):
    """For (id, text) rows: (size of the set, place of the first row of the component), by all pairs."""
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def key_of(*values):
    return hashlib.md5("".join("n" if v is None else f"v{len(str(v).encode())}:{v}" for v in values).encode()).digest()


def brute_targets(size, weights=(3, 1, 2), share=1.5, most=2):
    """Targets of sources by sharing out the excess until none is above its limit."""
    names = sorted(size, key=lambda x: (x is None, x))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    budget, target, left = Fraction(share) * sum(size.values()), {}, set(size)
    while left:
        rest = budget - sum(target.values())
        part = {s: rest * weight[s] / sum(weight[t] for t in left) for s in left}
        over = {s for s in left if part[s] > most * size[s]}
        target |= {s: Fraction(most * size[s]) for s in over} if over else part
        left = left - over if over else set()
    return target, budget


def brute_mix(rows):
    """(id, text, source) rows: how many copies all rows of a key get, by queueing every row alone."""
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    target, budget = brute_targets(size)
    names = sorted(size, key=lambda x: (x is None, x))
    queue = []
    for place, s in enumerate(names):
        own = []
        for i, t, _ in (r for r in rows if r[2] == s):
            g = key_of(i, t, s)
            own.append((hashlib.md5(str(i).encode() if i is not None else g).hexdigest(), (1 << 63) - 1 if i is None else i, len(WORD.findall(t or "")), g))
        upto, copy, last = 0, 0, None
        for x in sorted(own):
            upto, copy, last = upto + x[2], copy + 1 if x == last else 0, x
            for turn in range(2):
                if x[2]:
                    queue.append((float((turn * size[s] + upto) / float(target[s])), place, turn, *x, copy))
    run, times = 0, collections.Counter({key_of(*r): 0 for r in rows})
    for x in sorted(queue):
        run += x[5]
        if run > budget:
            break
        times[x[6]] += 1
    return times
