"""Training-data pipeline operators: ten document, URL and vector operators for very large corpora."""
