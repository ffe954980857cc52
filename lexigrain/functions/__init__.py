"""Part of lexigrain."""
