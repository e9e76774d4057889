"""Training-data operators: each module is self-contained; nothing outside this subpackage imports them."""
