"""Query catalogue: one function and one SQL text for each operator."""
