"""Inputs that the registered queries derive from the given tables; not part of the engine."""
