"""Training-data operators. Nothing outside this package imports it; the driver's entry adds its queries when it is present."""
