"""Operators for training data: linked names, quantile sketches, near duplicates, packing, mixing and splitting."""
