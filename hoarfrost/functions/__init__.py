"""Part of hoarfrost."""
