"""Corpus preparation for training data: thirteen operators and the queries that apply them to whole tables."""
