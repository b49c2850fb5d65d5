"""DataFrame operators: nodes, graph, versions, catalogue, tree, retrieval, windows, upserts."""
