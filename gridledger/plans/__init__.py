"""Jobs that combine sources and operators."""
