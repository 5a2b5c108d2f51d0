"""RNA homology analytics and training-data operators on PySpark."""
