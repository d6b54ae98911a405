"""DataFrame to DataFrame: shaping, applying deltas, parity, log reports."""
