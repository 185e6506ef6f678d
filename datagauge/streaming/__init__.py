"""Nothing here: the specified operators are all batch operators."""
