"""claimloom: a PySpark-native claim/evidence verification and text-processing engine.

Layers: ``functions`` (column expressions), ``operators`` (DataFrame -> DataFrame), ``sources``
(readers, text store), ``plans`` (registered queries and their SQL), ``streaming`` (micro-batch
entry points). Nothing here imports the optional ``llm`` subpackage.
"""

__version__ = "0.1.0"
