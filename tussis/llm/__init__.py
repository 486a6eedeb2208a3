"""Training-data operators: counting, scanning, filtering, scoring, dividing, mixing, comparing and archiving texts."""
