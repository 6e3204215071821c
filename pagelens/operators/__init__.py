"""DataFrame jobs, one module per subject."""
