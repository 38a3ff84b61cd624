"""Catalogue-scale comparison of recorded performances, as Spark DataFrame operators."""
