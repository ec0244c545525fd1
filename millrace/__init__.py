"""millrace: batch data pipelines around model inference, written for Spark."""
