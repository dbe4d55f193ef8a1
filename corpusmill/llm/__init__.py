"""Training-data operators. Nothing else in corpusmill imports this subpackage."""
