"""Operators for building training corpora; nothing else in lexilink imports this subpackage."""
