"""Readers, writers and the event roll-up."""
