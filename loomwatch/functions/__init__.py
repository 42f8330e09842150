"""Part of loomwatch."""
