"""Training-data operators: scanning, filtering, de-duplication, tokenisation."""
