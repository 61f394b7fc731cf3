"""Models over feature vectors, and the plans that train and serve them."""
