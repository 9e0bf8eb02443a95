"""Operators that also take a streaming DataFrame.

They are maps over the rows, keep no state and start no job of their own on the
rows, so a stream passes through them unchanged.  ``step_log`` holds what keeps state:
flags and statistics of a training log as it arrives.  Everything else that ranks, samples
exactly or aggregates a whole table is for finite tables only.
"""

from duotext.operators.encoding import encode_pair, encode_text
from duotext.operators.learning import predict, predict_proba
from duotext.operators.pairs import (
    binarize_01,
    class_partition,
    confident_rows,
    drop_columns,
    label_isin,
    label_to_int,
    letter_label,
    merge_neutral,
    pair_text,
    select_model_columns,
    silver_minority_only,
)
from duotext.operators.sampling import random_split
from duotext.operators.shift import adjust_probs, apply_class_weights, update_probs
from duotext.streaming.step_log import best_so_far_stream, write_epoch_stats, write_flags

__all__ = [
    "adjust_probs", "apply_class_weights", "best_so_far_stream", "binarize_01", "class_partition", "confident_rows",
    "drop_columns", "encode_pair", "encode_text", "label_isin", "label_to_int", "letter_label",
    "merge_neutral", "pair_text", "predict", "predict_proba", "random_split", "select_model_columns",
    "silver_minority_only", "update_probs", "write_epoch_stats", "write_flags",
]
