"""Small frames and plain re-computations shared by the tests of the corpus operators."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=""):
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    words = re.findall("[^\x20\x09-\x0D]+", lower_ascii(text))
    if not words:
        return set()
    return {tuple(words)} if len(words) < k else {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def components(texts, k=5):
    """Smallest index reachable over links of shingle Jaccard >= 0.8, all pairs compared."""
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]
