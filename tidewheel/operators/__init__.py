"""Operators over the canonical long form: (variable, condition, subject, time, value) with NULL for missing values."""
