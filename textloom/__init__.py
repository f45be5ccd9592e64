"""Spark-native preparation and scoring of text generation and labelling datasets."""
