"""Column-level functions: SQL expressions (``text``) and the two pandas UDFs (``udfs``)."""
