"""Plan building blocks that stay even under skewed keys."""
