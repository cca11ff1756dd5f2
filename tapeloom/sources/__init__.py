"""Readers, normalisers, keyed writes and adapter views."""
