"""Corpus analytics on Spark: files and prose in, classified, linked, ranked and narrated tables out."""
