"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage; it is optional and
``__spark_entry__.py`` registers its queries only where it is present.
"""
