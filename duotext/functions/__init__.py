"""Column-level functions."""

from duotext.functions.hashing import hash_int, hash_key
from duotext.functions.labels import binarize, label_int, letter_to_int, neutral_to_zero
from duotext.functions.scores import (
    argmax_label,
    bce,
    class_at,
    confidence,
    nll,
    normalize_scores,
    one_hot,
    softmax,
    weighted_posterior,
)
from duotext.functions.text import attention, elapsed, joined_pair, padded, tokens, truncated_lengths

__all__ = [
    "argmax_label", "attention", "bce", "binarize", "class_at", "confidence", "elapsed", "hash_int",
    "hash_key", "joined_pair", "label_int", "letter_to_int", "neutral_to_zero", "nll",
    "normalize_scores", "one_hot", "padded", "softmax", "tokens", "truncated_lengths",
    "weighted_posterior",
]
