"""Optimum contribution selection and data preparation as Spark plans."""
