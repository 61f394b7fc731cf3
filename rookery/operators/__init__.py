"""DataFrame to DataFrame: player features, rankings, comparisons, samples."""
