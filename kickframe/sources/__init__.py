"""Feed readers, payload flatteners and sinks."""
