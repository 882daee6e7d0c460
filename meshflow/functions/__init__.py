"""Part of meshflow."""
