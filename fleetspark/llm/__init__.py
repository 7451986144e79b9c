"""Training-data operators (near-dedup, filters, classifiers, archives, packing).

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries only when it is there.
"""
