"""Training-data operators (one module each) and the queries built on them."""
