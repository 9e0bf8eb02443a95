"""Recipes: compositions of operators exposed as one call."""

from duotext.plans.recipes import (
    Encoding,
    fit_encoding,
    keyed_source,
    load_encoding,
    minority_boosted,
    prepare,
    prepare_annotated_test,
    prepare_gold_silver,
    prepare_minority_boost,
    prepare_pairs,
    recipe_name,
)

__all__ = [
    "Encoding", "fit_encoding", "keyed_source", "load_encoding",
    "minority_boosted", "prepare", "prepare_annotated_test", "prepare_gold_silver",
    "prepare_minority_boost", "prepare_pairs", "recipe_name",
]
