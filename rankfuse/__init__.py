"""rankfuse: hybrid (lexical + link-rank) document search and evaluation as Spark DataFrame operators.

Library functions take DataFrames and return DataFrames. They start no session and read no
paths, except the helpers in ``rankfuse.sources`` and the staged pipeline in ``rankfuse.plans``.
"""

__version__ = "0.1.0"
