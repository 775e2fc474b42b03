"""Training-data operators: ten distributed text operators and their thin queries.

Nothing else in the library imports this package; ``__spark_entry__`` adds its
queries only when it can be imported.
"""
