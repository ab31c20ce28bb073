"""genmeta: generation metadata of image lakes, and training-data operators, as Spark jobs."""
