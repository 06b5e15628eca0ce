"""How iterative and sequential algorithms run on Spark."""
