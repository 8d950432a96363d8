"""Numerical kernels; pure NumPy, no Spark."""
