"""Feed loaders and the stored daily summary."""
