"""DataFrame operators: ranking primitives, preparation, losses, group metrics, runs, text, models."""
