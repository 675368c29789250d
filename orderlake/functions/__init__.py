"""orderlake subpackage."""
