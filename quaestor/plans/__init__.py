"""Session-level helpers and composed dataflows."""
