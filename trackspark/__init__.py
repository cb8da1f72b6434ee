"""Object-trajectory analytics and training-data operators on PySpark."""
