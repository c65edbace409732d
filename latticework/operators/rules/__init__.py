"""Architecture rules: each gives violations and diagnostics as DataFrames, and a status of four values."""
