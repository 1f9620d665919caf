"""Pure Column expressions: unit repair, rule bands, scalar helpers."""
