"""DataFrame operators: context, decisions, actions, retrieval, integrity, reports."""
