"""Small inputs and brute-force versions for the llm operator tests."""

import re

import numpy as np

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

ODD_TEXTS = [
    None, "", " ", "\n\n", "x", "one two", "Ünïcode wörds ßtraße", "a" * 5000, "same text here", "same text here",
    "tab\tand\x0bvt  two  spaces \n\nlines", "emoji 😀 and <|endoftext|> inside <|startoftext|>", "no-break\xa0space\x85nel",
    "ΣΊΣΥΦΟΣ İstanbul ﬁ ½ ²", "don't we'll I'm 's 12345 ___ ###", "word " * 300,
]


def documents(spark, texts, ids=None):
    """doc_id, text and columns whose names clash with the operators' own."""
    rows = [(i if ids is None else ids[i], t, "x", 1, 2.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, start int, score double")


def empty(spark, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame([], schema)


def near_roots(prints, ids, bits=2):
    """Smallest id reachable over fingerprints at ``bits`` or fewer."""
    fp = np.array(prints, np.uint64)
    root = list(range(len(fp)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= bits):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(fp))]


def kept_after_windows(rows, window):
    """Per ``(doc_id, text)``: words, words removed, kept words joined."""
    first, split = {}, [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        if d is not None:
            for a in range(len(w) - window + 1):
                k = tuple(w[a:a + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for a in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[a:a + window])] < d:
                gone.update(range(a, a + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out
