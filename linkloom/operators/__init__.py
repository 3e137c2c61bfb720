"""DataFrame to DataFrame: enrichment, states, queue, metadata, domains, statistics, graphs."""
