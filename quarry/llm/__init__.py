"""Training-data operators: each module is one operator, ``catalog`` registers
their queries. Nothing outside this folder imports it."""
