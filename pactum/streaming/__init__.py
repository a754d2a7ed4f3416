"""Contract validation of streams, an extension: micro-batches go through the batch validator."""
