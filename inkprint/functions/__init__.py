"""Column functions: text in, text or arrays out, no shuffle."""
