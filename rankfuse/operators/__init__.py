"""DataFrame operators: ordering/sampling, graph, text features, search, evaluation."""
