"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage; ``queries`` holds what
``__spark_entry__`` registers.
"""
