"""DataFrame operators: positions, selection, hints, prompts, batches and metrics."""
