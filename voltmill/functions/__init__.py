"""Numpy kernels that run inside Arrow batches, and scalar helpers."""
