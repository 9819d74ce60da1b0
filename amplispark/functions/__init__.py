"""Part of amplispark."""
