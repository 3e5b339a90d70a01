"""Operators for training-data preparation: joins of near copies, repeated text, tokens,
quality, benchmark leaks, shards, languages and language models.  Nothing else in the
library imports this subpackage."""
