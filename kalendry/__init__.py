"""kalendry: catalogues of dated, zone-aware events on Spark, and corpus jobs in ``kalendry.llm``."""
