"""Plans that chain operators: feed loads, enrichment and rescoring."""
