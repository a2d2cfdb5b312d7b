"""Plain versions of what the operators compute in bulk."""

import math
import re

import numpy as np

from ledgerlens.llm import toxicity
from ledgerlens.llm.hashing import U, pair_hash, word_hash


def places_by_hand(text):
    """Places of a text's terms and of their stems, one term after another."""
    out = set()
    for term in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower()):
        data = np.frombuffer(term, np.uint8)
        out.add(int(word_hash(data, np.array([0]), np.array([len(data)]))[0] % U(toxicity.PLACES)))
        for n in toxicity.STEMS:
            if len(data) > n:
                out.add(int(pair_hash(word_hash(data, np.array([0]), np.array([n])), np.full(1, 7, U))[0] % U(toxicity.PLACES)))
    return out


def score_by_hand(text, weights, bias):
    logit = bias + sum(float(np.float32(weights[p])) for p in places_by_hand(text))
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, logit))))
