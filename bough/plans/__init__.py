"""From a description and a request to plans."""
