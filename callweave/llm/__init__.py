"""Jobs that prepare text corpora for model training."""
