"""The engine's operators bound to the driver's tables."""
