"""Spark ML fits and the Spark jobs built on fitted trees (quantile leaves, Tree SHAP)."""
