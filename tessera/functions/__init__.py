"""Column-level functions: text, JSON, URL and vector expressions (``scalar``),
exact money arithmetic (``money``) and the pandas per-group helper (``udfs``)."""
