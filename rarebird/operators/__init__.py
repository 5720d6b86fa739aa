"""Data preparation, profiling, models and evaluation on DataFrames.

Functions whose name starts with ``fit_`` run a job and return a few model
parameters; everything else is lazy.
"""
