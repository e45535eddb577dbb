"""Small corpora with hot groups, copies, ties and odd rows, and brute-force versions."""

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def edited(rng, text, k):
    words = text.split(" ")
    for _ in range(k):
        words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
    return " ".join(words)


def corpus(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(6, 200)) for _ in range(60)]
    hot, passage = prose(rng, 120), prose(rng, 70)
    texts = [*base, *[hot] * 15, *[edited(rng, hot, rng.randrange(1, 6)) for _ in range(40)]]
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(30)]
    texts += [edited(rng, b, rng.randrange(1, 4)) for b in base for _ in range(rng.randrange(3))]
    texts += [None, "", "   \n\t", "one", "one", "one two three four", "One  two\nthree four", "a b c d e", prose(rng, 30_000), "　x y z", "é" * 5000]
    rng.shuffle(texts)
    return list(enumerate(texts))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def components(nodes, links):
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
