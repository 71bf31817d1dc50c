"""Column-level helpers: every function returns a ``pyspark.sql.Column`` built
from built-in expressions, so it stays inside whole-stage codegen."""
