"""Training-data operators. Nothing outside this subpackage imports it but the driver's entry module."""
