"""Training-data operators: packing, personal data, page text, nearest neighbours, licences, quality, urls, near copies,
benchmark leaks, toxicity.  Nothing else in the library imports this subpackage."""
