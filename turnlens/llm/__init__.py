"""Operators for preparing training text at corpus scale.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its
queries when it is present.
"""
