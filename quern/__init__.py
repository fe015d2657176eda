"""quern: dataset-curation analytics on Spark."""
