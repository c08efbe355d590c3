"""Column helpers and the scalable ordered-index / prefix-sum building block."""
