"""Training-data operators: quality rules and classifiers, language-model scores, exact, near and substring
de-duplication, secret scans, source mixing and sequence packing. Each module is one operator."""
