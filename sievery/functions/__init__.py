"""Part of sievery."""
