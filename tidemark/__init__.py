"""Panel analytics on Spark: bars, causal features, labels, folds, metrics and back-tests as lazy DataFrame plans."""
