"""DataFrame-to-DataFrame operators over recordings."""
