"""Writers of the delivered formats."""
