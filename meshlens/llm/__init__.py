"""Training-data operators: tokens, copies, languages, licences, toxicity, pages, private data."""
