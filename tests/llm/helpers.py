"""Small hostile tables and brute-force versions."""

from __future__ import annotations

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = WORDS.findall(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def least_reachable(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


BASE = "The quick brown fox jumps over the lazy dog near the river bank while seven wise owls watch from the old tree and count the stars one by one until morning comes again".split()


def odd_documents():
    """(doc_id, text): nulls, empties, ties, copies, near copies, odd spaces, one very long text."""
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
    texts = [None, "", "   \t\n", "one", "ONE", "a b c d", "a  b c d ", " lead", "tail ", "x y   z", "no▁break ▁ sign", "<|endoftext|> token <s> </s>", "日本 語🙂 text", "password: hunter2hunter2", long, long, long + " extra words at the end"]
    texts += [" ".join(BASE)] * 3 + [" ".join(BASE).upper(), " ".join(BASE[:-1]), " ".join([*BASE, "tail"]), " ".join(BASE[:20]), " ".join(["new", *BASE])]
    texts += [" ".join(f"v{(i * j) % 311}" for i in range(j)) for j in (4, 5, 6, 63, 64, 65, 80, 81, 200, 201)]
    return list(enumerate(texts))
