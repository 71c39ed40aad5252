"""Tributary: many same-schema sources presented as one Spark table.

The federation engine lives in :mod:`tributary.plans.engine`; nothing here
imports the optional ``llm`` subpackage.
"""

__version__ = "0.1.0"
