"""Read models and domain pipelines put together from operators."""
