"""Training-data operators: mixing, search, extraction, quality, tokens, fingerprints, privacy, joins, chat.

Nothing outside this package imports it; ``registry`` lists its queries.
"""
