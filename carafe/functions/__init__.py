"""Column functions: text folding, prices, quality scores, tokens and taste. All are JVM-side expressions."""
