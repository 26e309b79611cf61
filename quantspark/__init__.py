"""Quantitative risk, signal and corpus analytics on Spark."""
