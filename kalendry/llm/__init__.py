"""Training-data operators: ten Spark jobs over document, label and vector tables."""
