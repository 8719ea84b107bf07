"""Training-data operators: quality, language, tokens, privacy, chat, near copies, mixing, search, toxicity.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries when it is there.
"""
