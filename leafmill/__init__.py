"""Document cleaning on Spark: normalise, classify and rebuild lines of extracted text."""
