"""Column-metadata standardisation and corpus preparation on PySpark."""
