"""Spark ML training, tuning, evaluation and refits (ML1-ML6, ML14-ML15)."""
