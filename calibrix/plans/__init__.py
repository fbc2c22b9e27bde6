"""Query plans: the registry of named queries and their independent SQL oracles."""
