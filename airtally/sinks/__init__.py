"""Report delivery."""
