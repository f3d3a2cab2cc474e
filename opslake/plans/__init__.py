"""Reusable plan shapes that keep hot keys and long histories spread out."""
