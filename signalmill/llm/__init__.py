"""Operators of a training-data pipeline.

The subpackage stands alone: nothing else in the library imports it, and
``queries()`` and ``oracle_sql()`` of :mod:`signalmill.llm.registry` are what
the entry module adds.
"""
