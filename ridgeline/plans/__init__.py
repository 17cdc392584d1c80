"""Whole studies: factor catalogue, evaluation kernels, screening, resampling, audits."""
