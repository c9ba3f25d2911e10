"""Part of lidarloom."""
