"""Operators for preparing training text: quality, packing, archives, deduplication, decontamination, language.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
