"""Training-data operators: chat rendering, decontamination, URL filters, packing, near-dedup,
quality, language ID, personal data, source mixing and toxicity.

Nothing else in the library imports this subpackage. Every module states its contract, and what it
does with nulls, empty and very long texts, ties, repeated rows and empty tables, in its docstring.
"""
