"""Scalar functions and Arrow kernels over bytes, text, audio and pixels."""
