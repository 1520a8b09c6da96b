"""Readers for manuscripts and bibliographies."""
