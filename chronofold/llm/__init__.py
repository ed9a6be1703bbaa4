"""Training-data operators: search, archives, media, chat, toxicity, language, mixing, quality, near duplicates, tokens, contamination, fill-in-the-middle, whitening.

Nothing outside this subpackage imports it.
"""
