"""boardlake: PySpark operators for game event logs and detection labels."""
