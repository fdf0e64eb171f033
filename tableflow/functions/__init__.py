"""Column-expression builders.  Each returns a ``Column`` (or a projected
DataFrame) made only of built-in Spark expressions, so it runs inside
whole-stage codegen with no Python on the executors."""
