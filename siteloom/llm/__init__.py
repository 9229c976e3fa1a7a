"""Training-data operators: media, quality, dedup, tokens, chat, language, mixing and toxicity.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is there.
"""
