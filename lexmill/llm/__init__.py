"""Training-data operators (terms, fusion, sentences, names, scans, leaks, mixtures, truncation)."""
