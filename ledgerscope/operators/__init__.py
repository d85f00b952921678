"""DataFrame to DataFrame operators over nodes, edges, labels, scores and alerts."""
