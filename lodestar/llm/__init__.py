"""Training-data operators: quality, toxicity, near duplicates, tokens, packing, pages and media.

Nothing outside this package imports it; deleting it leaves the SQL engine whole.
"""
