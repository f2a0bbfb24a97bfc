"""Code-review analytics on Spark: source trees in, ranked findings and scan reports out."""
