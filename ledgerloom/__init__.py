"""ledgerloom: a PySpark-native reconciliation analytics engine.

Sub-packages: ``sources`` (readers), ``functions`` (column helpers), ``operators`` (DataFrame operators),
``plans`` (multi-stage pipelines), ``streaming`` (structured streaming twins), ``queries`` (named queries with SQL),
and ``llm`` (optional: operators for training-data pipelines; nothing else imports it).
"""

__version__ = "0.1.0"
