"""Part of quaestor."""
