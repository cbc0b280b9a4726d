"""Column functions: built-in expressions only, so they stay in generated code."""

from .genetics import (
    centred,
    cubic_label,
    decode_call,
    delta_f_percent,
    effective_parents,
    footprint_bytes,
    half_weight,
    markers_for,
    real_roots,
    recovered_dosage,
    recoded_sex,
    rounded,
)

__all__ = [
    "centred", "cubic_label", "decode_call", "delta_f_percent", "effective_parents", "footprint_bytes", "half_weight",
    "markers_for", "real_roots", "recovered_dosage", "recoded_sex", "rounded",
]
