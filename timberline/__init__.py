"""A tabular learning engine on Spark: profiles, bins, folds, trees, linear models, metrics and explanations as DataFrame operations."""

__version__ = "0.1.0"
