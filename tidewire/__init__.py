"""tidewire: media-intelligence and corpus processing as Spark DataFrame jobs."""
