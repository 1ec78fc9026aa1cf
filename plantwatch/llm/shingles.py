"""Words and word shingles as 64-bit hashes, for whole batches of texts at a time."""

import re

import numpy as np
import pandas as pd

WORD = re.compile(r"\w+")
WIDTH = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text):
    """Lower-case runs of letters, digits and underscores; null has none."""
    return WORD.findall((text or "").lower())


def mix(values):
    """Scramble 64-bit values so that any of their bits can be used alone."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_hashes(texts):
    """Hashes of all words of all texts in order, and the number of words of each text."""
    cut = [words(t) for t in texts]
    flat = [w for c in cut for w in c]
    hashes = pd.util.hash_array(np.array(flat, dtype=object), categorize=False) if flat else np.empty(0, np.uint64)
    return hashes, np.fromiter(map(len, cut), np.int64, len(cut))


def fold(hashes, width):
    """A hash for every run of ``width`` neighbours."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    run = np.zeros(n, np.uint64)
    for k in range(width):
        run = run * _STEP + hashes[k:k + n]
    return mix(run + np.uint64(width))


def shingles(texts, width=WIDTH):
    """For each text the hashes of its shingles, in order and with repeats.

    A text of fewer words than ``width`` has one shingle of all its words; a text without words has none.
    """
    hashes, counts = word_hashes(texts)
    runs, ends = fold(hashes, width), np.cumsum(counts)
    found = []
    for n, end in zip(counts.tolist(), ends.tolist()):
        found.append(runs[end - n:end - width + 1] if n >= width else fold(hashes[end - n:end], n))
    return found


def weighed(values):
    """Distinct hashes in ascending order and how often each occurs."""
    return np.unique(values, return_counts=True)
