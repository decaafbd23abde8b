"""Operations for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  ``llm.queries`` has the
query functions and their SQL; every other module is one operator.
"""
