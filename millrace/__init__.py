"""Spark-native text-corpus analytics: cleaning, gating, deduplication, packing and reporting."""
