"""Operators for building training corpora; nothing outside this folder imports it."""
