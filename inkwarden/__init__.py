"""Message-risk analytics on Spark: scoring, corpora, evaluation and operations tables."""
