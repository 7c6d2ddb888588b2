"""Part of tarnwell."""
