"""pairlens: paired-experiment analytics as plain PySpark DataFrame functions."""
